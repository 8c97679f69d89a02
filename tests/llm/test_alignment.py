"""Alignment of two tokenizers against plain loops over the libraries' own ids."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loamworks.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox jumps over the lazy dog, twice.",
    "Été à Zürich: 12 °C; naïve café – ﬁn ① 漢字 кириллица 😀",
    "a  b   c\td\n\ne \r\nf \n",
    " leading and trailing ",
    "<|endoftext|> is text and <s> too, as <0x41> is",
    "x▁y has the blank sign",
    "\x00\x01 control \x1c\x85 \xa0nbsp　wide",
    "word " * 400 + "end",
    "nosuchblanks" * 300,
    "it's we'll I'm 'tis 1,000.50 3x4 __init__ foo_bar(baz) {\r\n}",
    "",
    None,
    "\n",
    " ",
    "line\nline\nNext line. Another\nLine",
    "The quick brown fox jumps over the lazy dog, twice.",
]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    out, count = [], Counter()
    for t in texts:
        raw = (" " + t).encode() if t else b""
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [alignment.byte_level_bytes(a.id_to_token(i)) for i in ids_a]
        bytes_b = [alignment.piece_bytes(b.id_to_piece(i)) for i in ids_b]
        if not t or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(ids_a[ends_a.index(c)], ids_b[ends_b.index(c)]) for c in cuts]
        count.update(links)
        groups, low = [], 0
        for c in cuts:
            groups.append([[i for i, e in zip(ids, ends, strict=True) if low < e <= c] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))])
            low = c
        out.append((ids_a, ids_b, groups, links))
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    rows = []
    for ids_a, ids_b, groups, links in out:
        said = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if ids_a else ""))
    return rows, out, count


@pytest.mark.parametrize("most", [300_000, 40])
def test_scores_and_groups_equal_plain_loops(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "PIECE_CHARS", most)
    monkeypatch.setattr(alignment.pieces, "__defaults__", (most,))
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, links int")
    x = alignment.Alignment(spark, d, A, B)
    got = {r["doc_id"]: tuple(r)[1:] for r in x.scores().collect()}
    rows, out, count = plain(TEXTS)
    for i, want in enumerate(rows):
        assert got[i] == want, TEXTS[i]
    assert got[5][0] == 0 and got[1][0] > 0
    assert {(r["a"], r["b"]): r["count"] for r in x.pairs(spark).collect()} == dict(count)
    parts = {}
    for r in alignment.groups(d, A, B).collect():
        parts.setdefault(r["doc_id"], []).append(r)
    for i, (ids_a, _, groups, _) in enumerate(out):
        mine = sorted(parts.get(i, []), key=lambda r: r["piece"])
        if ids_a:
            assert [t for r in mine for t in r["a"]] == ids_a
            assert sum(len(r["cuts"]) for r in mine) == len(groups) and mine[-1]["cuts"][-1] == len((" " + TEXTS[i]).encode())
            first = mine[0]
            assert [first["a"][s:e] for s, e in zip([0, *first["until_a"]], first["until_a"], strict=False)] == [g[0] for g in groups[: len(first["cuts"])]]


def test_long_texts_in_pieces_have_the_same_ids(spark):
    t = alignment.loaded(A, B)
    text = ("Some words, and 12 more; l'été\nof  two " * 20_000).strip()
    parts = alignment.pieces(text, 10_000)
    assert " ".join(parts) == text and len(parts) > 50
    whole, cut = alignment.align(t, [text]), alignment.align(t, parts)
    assert (whole.a == cut.a).all() and (whole.b == cut.b).all() and (whole.cut == cut.cut).all()
    assert alignment.pieces("x" * 50_000, 10_000) == ["x" * 50_000]


def test_bits_rank_and_select():
    rng = np.random.default_rng(2)
    places = np.flatnonzero(rng.random(1000) < 0.3)
    bits = alignment.Bits.of(places, 1000)
    assert (bits.places() == places).all()
    at = np.arange(1000)
    assert (bits.rank(at) == np.searchsorted(places, at, "right")).all()
    assert not len(alignment.Bits.of(np.zeros(0, np.int64), 0).places())


def test_nulls_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.Alignment(spark, d, A, B).scores().collect()), key=str)
    rows, _, _ = plain(["one two", "one two", None])
    assert got == sorted([(None, *rows[0]), (None, *rows[1]), (3, *rows[2])], key=str) and rows[0][5] == 4
    assert alignment.Alignment(spark, d.limit(0), A, B).scores().collect() == []
    assert alignment.groups(d.limit(0), A, B).collect() == []
