import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.packing import encoder, pack, plan, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "Hello world, it's  fine.\n\n\tNo?", " lead", "trail ", "x" * 9000, "né à ß œ " * 50, "日本語 テキスト", "<|endoftext|> in text", "a b\x1cc\x85d e", "don't 'S'll", "\n\n a\n b  ", "emoji 🙂 ok", " ".join(f"w{i}" for i in range(7000)), "one two " * 200_000]


def test_encoder_equals_the_tokenizer():
    tok = Tokenizer.from_file(PATH)
    for t in TEXTS:
        assert np.frombuffer(encoder(PATH).encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 'st²½ºª_٣\n\t.é1🙂 \x1d中"), max_size=60))
def test_encoder_equals_the_tokenizer_on_odd_texts(t):
    assert np.frombuffer(encoder(PATH).encode(t), "<u4").tolist() == encoder(PATH).tokenizer.encode(t, add_special_tokens=False).ids


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.n += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kw)


def test_new_short_pieces_cost_no_call_of_the_tokenizer():
    enc = packing.Encoder(PATH)
    plain = enc.tokenizer
    enc.tokenizer = Counting(plain)
    text = " ".join(f"thereon{i} wörd, (so {i}) don't\n" for i in range(500)) + "q" * 40
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert enc.tokenizer.n == 1  # the longest piece


def test_merges_equal_the_tokenizer():
    enc = packing.Encoder(PATH)
    rng = np.random.default_rng(1)
    pools = ["etaoinshrdlu", "ab", "aàéß€ñ", "".join(map(chr, range(33, 127))), "中🙂\u0301\x00\x7f¡"]
    pieces = sorted({" " * int(rng.integers(2)) + "".join(rng.choice(list(pools[k % 5]), int(rng.integers(1, 14)))) for k in range(5000)})
    pieces = [p for p in pieces if len(packing._SPLIT.findall(p)) == 1 and "'" not in p] + [" ", "\n", "\n\n", "'re", " " * 32]
    for width in (16, 32, 60):
        some = [p for p in pieces if len(p.encode()) <= width]
        want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert enc.merges.encode([p.encode() for p in some], width) == want
    assert packing._Merges.of({"model": {"type": "WordPiece", "vocab": {}}}) is None
    assert packing._Merges.of({"model": {"type": "BPE", "vocab": {"a": 0}, "merges": [["a", "b"]]}}) is None


def test_texts_met_together_are_each_encoded_as_alone(monkeypatch):
    monkeypatch.setattr(packing, "_STRETCH", 64)
    monkeypatch.setattr(packing, "_CACHE_SIZE", 90)
    enc = packing.Encoder(PATH)
    texts = [*TEXTS[:9], "x y " * 40 + "日本", "so it goes " * 30, "", *TEXTS[9:14]]
    for t, ids in zip(texts, enc.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 50)), max_size=12))
def test_plan_uses_every_length_once_and_overfills_nothing(pairs):
    counts = np.zeros(33, np.int64)
    for x, n in pairs:
        counts[x] += n
    used = np.zeros(33, np.int64)
    for lengths, n in plan(counts, 32):
        assert sum(lengths) <= 32 and n > 0
        for x in lengths:
            used[x] += n
    assert (used == counts).all()


def test_plan_is_close_to_the_least_number_of_sequences():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1, 20000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=2049)
    assert sum(n for _, n in plan(counts)) <= -(-lengths.sum() // 2048) + 1
    assert plan(np.bincount([3, 3, 2, 2, 2], minlength=7), 6) == [((3, 3), 1), ((2, 2, 2), 1)]


def test_documents(spark):
    texts = [None, *TEXTS, *TEXTS[:9], "same text here"] + ["same text here"] * 300
    rows = [(i if i else None, t, "x", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, part int").repartition(5)
    got = pack(df, PATH, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert len(by) == len(rows)
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum((r.ids for r in mine), []) == ids and [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert all(r.length == 2048 for r in mine[1:])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) == -(-sum(r.length for r in got) // 2048)
    whole = {r.sequence_id: r.ids for r in sequences(pack(df, PATH, with_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
