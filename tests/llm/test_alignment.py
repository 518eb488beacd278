"""Alignment of two tokenizers against whole texts encoded by the libraries and every pair compared."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
    return a, b, ranks, pieces


def ranges(ids, pieces):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(pieces[i])))
        at += len(pieces[i])
    return out


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    a, b, bytes_a, bytes_b = libraries
    docs = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if not raw or b"".join(bytes_a[i] for i in ids_a) != raw or b"".join(bytes_b[i] for i in ids_b) != raw:
            docs.append(([], [], []))
            continue
        span_a, span_b = ranges(ids_a, bytes_a), ranges(ids_b, bytes_b)
        links, low = [], 0
        for i, (s, e) in enumerate(span_a):
            while span_b[low][1] <= s:
                low += 1
            j = low
            while j < len(span_b) and span_b[j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        cuts = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, span_a) if start <= s and e <= cut) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, span_b) if start <= s and e <= cut))
            start = cut
        docs.append(((ids_a, ids_b), links, groups))
    count = Counter(x for _, links, _ in docs for x in links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for ids, links, groups in docs:
        n_a, n_b = (len(ids[0]), len(ids[1])) if ids else (0, 0)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


ODD = [
    "plain words, don't you know", "  two  blanks  ", " ", "   ", "\n", "a\n b\n\n  c \n", "tab\tand \x0b more\r\n end ", "<|endoftext|> </s><s> <unk> [INST] <0x0A>",
    "has ▁ its own mark", "▁", "nul\x00 \x00 here", "你好 世界。 \U0001f600\U0001f1e9\U0001f1ea", "wide　blank   em \x85 next \xa0 hard", "\x1c \x1d \x1f", "é ́ ﬁ ①",
    "123 4567 8.9e10", "x" * 300, " y" * 50, "z  " * 40, "\n\n \n \t ", "'s 't 've d'll I'M", None, "", "trailing ", "a" + " " * 37,
]


def test_cells_give_the_ids_of_whole_texts(libraries):
    pair = alignment.Pair(A, B)
    assert pair.cuts
    draw = random.Random(5)
    letters = [" ", "  ", "\n", "\t", "a", "the", "don't", " ", "\x85", "\x1c", "7", "!", "é", "你", "\U0001f600", "́", "<s>", "'"]
    texts = [t for t in ODD if t] + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for _ in range(3_000)]
    for text in texts:
        cells = alignment.cells_of(text)
        assert "".join(" " + c for c in cells) == " " + text
        (whole_a,), (whole_b,), (good,) = pair.encode([text])
        a, b, fine = pair.encode(cells)
        assert all(fine) == good
        assert sum(a, []) == whole_a == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == whole_b == libraries[1].encode(text)


def result(frame):
    return sorted(((r["doc_id"], *[r[c] for c in alignment.RESULTS]) for r in frame.collect()), key=repr)


def test_odd_texts_and_repeats(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 200)
    texts = ODD + ODD[:8] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = sorted(((i, *x) for i, x in enumerate(plain(texts, libraries))), key=repr)
    assert result(alignment.Alignment(rows, A, B).documents()) == expected


def test_whole_query(spark, sf_dir, libraries):
    from factframe.llm.queries import op12_tokenizer_alignment

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(((d["doc_id"], *x) for d, x in zip(docs, plain([d["text"] for d in docs], libraries), strict=True)), key=repr)
    assert result(op12_tokenizer_alignment(spark, sf_dir)) == expected


def test_tables_of_an_alignment(spark, libraries):
    rows = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, None)], "doc_id long, text string")
    made = alignment.Alignment(rows, A, B, groups=True)
    got = {r["doc_id"]: r["groups"] for r in made.documents().collect()}
    ids_a, ids_b = libraries[0].encode(" the cat", add_special_tokens=False).ids, libraries[1].encode("the cat")
    assert got == {1: ";".join(f"{x}|{y}" for x, y in zip(ids_a, ids_b, strict=True)), 2: got[1], 3: ""}
    assert sorted((r["a"], r["b"], r["count"], r["best"]) for r in made.pairs.collect()) == sorted((x, y, 2, True) for x, y in zip(ids_a, ids_b, strict=True))


def test_odd_tables(spark, odd_documents, no_documents):
    taken = odd_documents.withColumnRenamed("n", "n_a").withColumnRenamed("node", "a.b")
    got = alignment.Alignment(taken, A, B).documents()
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "score", "label", "n_a", "a.b", "n_a_", *alignment.RESULTS[1:]]
    rows = got.collect()
    assert len(rows) == taken.count()
    assert {r["groups_sha256"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    assert alignment.Alignment(no_documents, A, B).documents().count() == 0
