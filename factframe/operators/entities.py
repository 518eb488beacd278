"""Entity resolution by names: persons with initials, organisations by tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factframe.functions.text import name_tokens


def compatible(a: list[str], b: list[str]) -> bool:
    """Same surname and number of names; each given name equal, or one the initial of the other."""
    if len(a) != len(b) or not a or a[-1] != b[-1]:
        return False
    return all(x == y or (min(len(x), len(y)) == 1 and x[0] == y[0]) for x, y in zip(a[:-1], b[:-1], strict=True))


def _specific(tokens: list[str]) -> tuple[int, int]:
    return sum(len(t) > 1 for t in tokens), len(tokens)


def resolve_persons(mentions: DataFrame) -> DataFrame:
    """mention_id, name -> entity_id (least mention_id), canonical.

    Greedy in order of mention: a name joins the only entity that it fits, else
    founds one; a more specific name becomes canonical. Names fit only with the
    same surname and the same initials of all given names, so each such block is
    resolved by itself and blocks are spread over the cluster. Blocks come sorted
    and one after another, many in a task, as most names have a block of their
    own. Within a block the order of mention decides, so a task holds one block at
    a time: the mentions of one surname with one set of initials.
    """
    shape = "mention_id long, name string, entity_id long, canonical string"

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, entities, told = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*[(m, n, e["id"], e["name"]) for m, n, e in rows], strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string()) * 2, strict=True)], names=["mention_id", "name", "entity_id", "canonical"])

        for batch in batches:
            done: list[tuple] = []
            for surname, initials, mention_id, name, tokens in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (surname, initials) != block:
                    done += told
                    block, entities, told = (surname, initials), [], []
                fits = [e for e in entities if compatible(tokens, e["tokens"])]
                if len(fits) == 1:
                    entity = fits[0]
                    if _specific(tokens) > _specific(entity["tokens"]):
                        entity["tokens"], entity["name"] = tokens, name
                else:
                    entity = {"id": mention_id, "tokens": tokens, "name": name}
                    entities.append(entity)
                told.append((mention_id, name, entity))
            yield batch_of(done)
        yield batch_of(told)

    tokened = mentions.select("mention_id", "name", name_tokens(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    initials = F.array_join(F.transform(F.slice("tokens", 1, F.size("tokens") - 1), lambda t: F.left(t, F.lit(1))), " ")
    blocks = tokened.select(F.element_at("tokens", -1).alias("_surname"), initials.alias("_initials"), F.col("mention_id").cast("long").alias("mention_id"), "name", "tokens")
    return blocks.repartition("_surname", "_initials").sortWithinPartitions("_surname", "_initials", F.col("mention_id").asc_nulls_last()).mapInArrow(resolve, shape)
