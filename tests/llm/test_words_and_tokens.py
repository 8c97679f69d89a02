"""Words, token ids and the range coder against plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamworks.llm import rangecoder
from loamworks.llm.queries import tokenizer
from loamworks.llm.tokens import Encoder
from loamworks.llm.words import Words

TEXTS = ["", " ", "a", "A bC\td\n", "é É x", "one  two", None, "x" * 200_000 + " y", "\x0b\x0cz", "𝒳 ok"]


def test_words_match_the_pattern():
    w = Words(pa.array(TEXTS, pa.string()))
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in TEXTS]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    flat = [y for x in want for y in x]
    assert [w.text(i) for i in range(len(flat))] == flat
    by_hash = dict(zip(w.hash.tolist(), flat, strict=True))
    assert len(by_hash) == len(set(flat)) and all(by_hash[h] == x for h, x in zip(w.hash.tolist(), flat, strict=True))


def test_words_of_slices_and_nothing():
    a = pa.array(["no", "a b", None, "c"], pa.string()).slice(1)
    assert np.diff(Words(a).first).tolist() == [2, 0, 1]
    assert len(Words(pa.array([], pa.string())).hash) == 0


def test_ngrams_stay_in_texts():
    w = Words(pa.array(["a b c", "d", "a b"]))
    h, of = w.ngrams(2)
    assert of.tolist() == [0, 0, 2] and h[0] == h[2] and h[0] != h[1]


@pytest.mark.parametrize("name, words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("bits", [6, 20])
def test_ids_are_those_of_whole_texts(name, words, bits):
    r = random.Random(4)
    letters = "ab ZÉéß'’.,\n\t  1２—ǅİſK…́Σς"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice("ab  .c\n,DÉ") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "<|endoftext|> x", "\0 a", "a\x1cb", "don't  stop it's", "a.\n\nB"]
    e = Encoder(tokenizer(name), words, bits)
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for k in range(0, len(texts), 700):
        ids, at = e.encode(pa.array(texts[k : k + 700], pa.string()))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)] == want[k : k + 700]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 300, 5000, 70_000])
@pytest.mark.parametrize("kinds", [1, 2, 50, 50_257, 1 << 20, 1 << 30])
def test_blocks_round_trip(n, kinds):
    x = np.random.default_rng(n + kinds).integers(0, kinds, n).astype(np.uint32)
    assert np.array_equal(rangecoder.decode(rangecoder.encode([x]))[0], x)


def test_range_coder_largest_ids_repeated():
    x = np.tile(np.array([(1 << 30) - 1, 0, (1 << 30) - 1, (1 << 16) - 1, 1 << 16], np.uint32), 4000)
    assert np.array_equal(rangecoder.decode(rangecoder.encode([x]))[0], x)


def test_blocks_are_independent_of_their_company():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 300, n).astype(np.uint32) for n in (70_000, 65_536, 10, 0, 400, 9000)]
    together = rangecoder.encode(blocks)
    assert together == [rangecoder.encode([b])[0] for b in blocks]
    assert all(np.array_equal(a, b) for a, b in zip(rangecoder.decode(together[::-1]), blocks[::-1], strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, (1 << 30) - 1)), max_size=400))
def test_any_ids_round_trip(ids):
    x = np.array(ids, np.uint32)
    assert np.array_equal(rangecoder.decode(rangecoder.encode([x]))[0], x)


def test_repetition_is_cheap_and_damage_is_seen():
    x = np.tile(np.arange(1000, dtype=np.uint32), 70)
    data = rangecoder.encode([x])[0]
    assert len(data) < len(x) / 2
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    for broken in (bytes(bad), b"no", data[:-3]):
        with pytest.raises(ValueError):
            rangecoder.decode([broken])
    with pytest.raises(ValueError):
        rangecoder.encode([np.array([1 << 30], np.uint32)])


def test_plain_words_learned_side_by_side_have_the_librarys_ids():
    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from loamworks.llm.tokens import Encoder
    from loamworks.llm.words import Words

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), Encoder(path, words=False)
    texts = ["Word word, word. wörter Straße, É. Ġa . , a. it's 3 x," + "".join(f" {'ab' * i}{'.,'[i % 2]} z{'q' * i}" for i in range(150)), "once\nword. more", None, ""]
    w = Words(pa.array(texts), lower=False)
    plain = encoder._plain(w, np.arange(len(w.start)), encoder._before(w)[0])
    assert {"word,", "word.", "a.", "x,", "more"} <= set(w.texts(np.flatnonzero(plain))) and not {"Word", "Straße,", "it's", ".", ","} & set(w.texts(np.flatnonzero(plain)))
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_of_latin_letters_with_signs_are_learned_side_by_side_wherever_they_stand(monkeypatch):
    """op5's cost of new words: after blanks, line ends and at a text's beginning, those of one stem once."""
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), Encoder(path, words=False)
    seen, one_by_one = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words, before: seen.extend(words) or one_by_one(words, before))
    easy = ["Straße.%%%", "ǅungla", "cióndo###", "naïve!?", "word'", "\u023f", "ÀÖØöøÿ,"]
    hard = ["a×b", "÷", "it's", "x1", "Σς", "ªb", "ɐ", "a-b", "…", "é\u0301", "ﬁ", "\u2c7e"]
    r = random.Random(6)
    texts = ["".join(r.choice(easy + hard) + r.choice(" \n") for _ in range(9)) + r.choice(easy + hard) for _ in range(400)] + [*easy, *hard, "", None]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert set(hard) <= set(seen) and not set(easy) & set(seen)
    many = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts = [a + b + c for a, b in zip(many, many[1:], strict=False) for c in (" ", "\n")]
    got, _ = encoder.encode(pa.array(["".join(texts) + "end"]))
    assert got.tolist() == library.encode("".join(texts) + "end", add_special_tokens=False).ids


def test_tables_of_a_block_hold_its_ids_side_by_side():
    """Ids far apart have numbers next to each other, the same bytes as in files written before, and tables no wider than they need."""
    rng = np.random.default_rng(3)
    x = rng.choice(np.arange(7, 50_000, 97), 70_000).astype(np.uint32)
    y = np.where(rng.random(70_000) < 0.01, x + (1 << 20), x).astype(np.uint32)
    data = rangecoder.encode([x, y, x[:500]])
    assert [zlib.crc32(d) for d in data] == [3050676390, 553175202, 637481446]
    assert all(np.array_equal(a, b) for a, b in zip(rangecoder.decode(data), (x, y, x[:500]), strict=True))
    model = rangecoder._Model(1, 256, True)
    numbers = model.numbers(x[:256], False)
    assert numbers.max() <= len(np.unique(x[:256])) and np.array_equal(model.ids(numbers, False), x[:256])


def test_a_step_sums_the_gradients_of_words_that_recur():
    import numpy as np

    from loamworks.llm import pseudolikelihood as P

    t = P.Trainer(P.blank_weights(3), np.arange(P.SIZE), 0.1)
    rng = np.random.default_rng(1)
    ctx, before = rng.integers(0, 3, (4, 50)), t.w["embed"].copy()
    t.step(rng.integers(0, 900, 50), ctx, np.zeros(50, np.int64))
    g = t.g["embed"] - 1e-3
    assert (g[:, 3:] == 0).all() and (g[:, :3] > 0).all()  # only words that occur move
    assert (t.w["embed"][:, 3:] == before[:, 3:]).all() and np.isfinite(t.w["embed"]).all()


def test_places_of_hashes_are_those_of_a_binary_search():
    from loamworks.llm import pseudolikelihood as P

    rng = np.random.default_rng(2)
    top = (1 << 64) - 1
    for n in (1, 2, 7, 960, 20_000):
        known = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        for ends in (known, np.unique(np.concatenate([known, np.array([0, 1, top - 1, top], np.uint64)])), np.arange(n, dtype=np.uint64)):
            h = np.concatenate([ends[::3], rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, n, top], np.uint64)])
            assert (P.places(ends, h) == np.searchsorted(ends, h)).all()


def test_words_are_counted_over_pieces():
    """Many pieces in one task, more different words than are held at once."""
    import collections

    from loamworks.llm import pseudolikelihood as P

    texts = [" ".join(f"k{(i * 7919 + j) % 900_000} the" for j in range(150_000)) for i in range(0, 900_000, 90_000)] + [None, " "]
    expected = collections.Counter(" ".join(x or "" for x in texts).split())
    out = pa.Table.from_batches(P._count_words(iter(pa.record_batch([pa.array([x], pa.string())], names=["text"]) for x in texts)))
    words, kind, n = (out[c].to_numpy() for c in ("word", "ending", "n"))
    w = Words(pa.array([" ".join(expected)]))
    got, kinds = collections.Counter(), {}
    for h, k, m in zip(words[kind >= 0].tolist(), kind[kind >= 0].tolist(), n[kind >= 0].tolist(), strict=True):
        got[h] += m
        assert kinds.setdefault(h, k) == k
    assert len(words) > len(got)  # what was held went out before the end
    assert got == dict(zip(w.hash.view(np.int64).tolist(), expected.values(), strict=True))
    assert [kinds[h] for h in w.hash[:1000].view(np.int64).tolist()] == (P.endings(w) * P.PARTS + P.parts(w))[:1000].tolist()


def test_a_step_does_not_depend_on_the_order_of_its_rows():
    """Also where no row is of a class, every row is, or there is one."""
    from loamworks.llm import pseudolikelihood as P

    rng, first = np.random.default_rng(6), P.SIZE - P.ENDINGS
    for low, high, n in ((0, P.SIZE, 300), (0, first, 300), (first, P.SIZE, 300), (first + 3, first + 4, 1), (7, 8, 1)):
        ids, ctx, part = rng.integers(low, high, n), rng.integers(0, P.SIZE + 1, (4, n)), rng.integers(0, P.PARTS, n)
        order, made = rng.permutation(n), []
        for at in (np.arange(n), order):
            t = P.Trainer(P.blank_weights(5), np.arange(P.SIZE), 0.1)
            loss = t.step(ids[at], ctx[:, at], part[at])
            assert loss == pytest.approx(-float(P.log_probabilities(P.blank_weights(5), ids, ctx, np.arange(P.SIZE), part).mean()), abs=1e-4)
            made.append(P.flat(t.w))
        assert np.allclose(*made, atol=1e-5) and np.isfinite(made[0]).all()


_SCORING = """
import resource
import numpy as np, pyarrow as pa
from loamworks.llm import pseudolikelihood as P
rng = np.random.default_rng(5)
pieces = [pa.record_batch([pa.array([1]), pa.array([" ".join(f"w{x}" for x in rng.integers(0, 5000, 180_000))])], names=["doc_id", "text"]) for _ in range(8)]
net = P.Network((np.zeros(0, np.uint64), np.zeros(0, np.int64)), np.arange(P.SIZE), P.flat(P.blank_weights(24)), 24)
lexicon = P.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(P.ENDINGS * P.PARTS), np.zeros(P.ENDINGS * P.PARTS), np.zeros(65_536))
faults = []
for b in P._score(net, lexicon)(iter(pieces)):
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print(len(faults), (faults[-1] - faults[2]) // (len(faults) - 3))
"""


def test_scoring_does_not_fault_its_memory_in_anew():
    """The arrays of a piece are made in memory that the worker kept of the pieces before (in a process of its own, as a worker is)."""
    import os
    import pathlib
    import platform
    import subprocess
    import sys

    if platform.libc_ver()[0] != "glibc":
        pytest.skip("for glibc")
    run = subprocess.run([sys.executable, "-c", _SCORING], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2], env=os.environ | {"OMP_NUM_THREADS": "1"})
    pieces, faults = run.stdout.split()
    assert int(pieces) == 8 and int(faults) < 2000
