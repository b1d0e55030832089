"""SentencePiece encoding and training-order output."""

import os
import random
import struct
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ashlar.llm import sentencepiece_trie as sp
from ashlar.llm import training_order as to

MODEL = sp.DEFAULT_MODEL
ODD = ["", " ", "    ", " a", "a  b   c\n\n\td ", "①é ﬁ\x00▁x", "퟿😀😀 aaa aaaaaaaaaaaaaaa", "the The THE", "x" * 500, "ab" * 3000, "0000000000000 1111", " ⁇ ", "<s> </s> <0x41>", "▁▁ ▁", "日本語 текст", "日本語текст" * 40 + "a " + "日本語текст" * 40 + "b"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_same_ids_as_the_library(library, edge, sf_dir, spark):
    texts = ODD + [r.text or "" for r in edge.collect()] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(6)
    texts += ["".join(rng.choices(" \n▁abcétheing.,0é日", k=rng.randint(1, 40))) for _ in range(500)]
    own = sp.encoder(sp.read_model(spark))
    ids = own.encode_batch(texts)
    for t, x in zip(texts, ids):
        assert x.tolist() == library.encode(t), repr(t[:80])
        assert own.decode(x) == library.decode(x)


def test_few_words_may_be_kept(library, spark, monkeypatch):
    monkeypatch.setattr(sp, "KEPT", 5)
    own = sp.Encoder(sp.Model(sp.read_model(spark)))
    for t in ("one two three", "two four five six", "one seven eight nine two three"):
        assert [x.tolist() for x in own.encode_batch([t, t])] == [library.encode(t)] * 2


def test_what_no_piece_spans_is_no_new_word(library, spark, monkeypatch):
    """Words joined by line breaks, marks and digits cost no more than the words do; no pair of pieces is merged anew."""
    own = sp.Encoder(sp.Model(sp.read_model(spark)))
    monkeypatch.setattr(sp, "merge", lambda *a: pytest.fail("merged"))
    rng = random.Random(8)
    words = "the of data row table merge order quiet river stone light house paper green winter garden music letter window summer".split()
    texts = [" ".join(f"{rng.choice(words)}.\n{rng.choice(words)} {rng.randrange(10**9)}" for _ in range(50)) for _ in range(20)]
    seen = []
    encode_words = own.encode_words
    monkeypatch.setattr(own, "encode_words", lambda new: encode_words(seen.extend(new) or new))
    for t in texts:
        assert own.encode_batch([t])[0].tolist() == library.encode(t)
        assert "".join(own.words_of(t)) == sp.MARK + t.replace(" ", sp.MARK)
    assert len(seen) <= 2 * len(words) + 13  # with and without a mark, ten digits, a lone mark, a point, a line break


def test_long_words_are_not_kept(library, spark):
    own = sp.Encoder(sp.Model(sp.read_model(spark)))
    texts = ["abcd" * n + " word" for n in (20, 5000)]
    for _ in range(2):
        assert [x.tolist() for x in own.encode_batch(texts)] == [library.encode(t) for t in texts]
    assert max(map(len, own.known)) <= sp.LONG and "▁word" in own.known


def test_shared_classes_make_fewer_cuts(library, spark, monkeypatch):
    monkeypatch.setattr(sp, "CLASSES", 8)
    own = sp.Encoder(sp.Model(sp.read_model(spark)))
    assert [x.tolist() for x in own.encode_batch(ODD)] == [library.encode(t) for t in ODD]


@pytest.mark.parametrize("kind", ["falling scores", "ties", "any scores"])
def test_bpe_is_merging_for_any_vocabulary(kind):
    """Small vocabularies, also such as no training gives, against merging whole texts; pairs of pieces against merging the two."""
    long = 0
    for seed in range(60):
        rng = random.Random(seed)
        names = list("abc▁")
        pieces = dict.fromkeys(names, 0.0)
        for k in range(rng.randint(1, 25)):
            p = "".join(rng.choices("abc▁", k=rng.randint(2, 5))) if kind == "any scores" else rng.choice(names) + rng.choice(names)
            if p not in pieces:
                pieces[p] = {"falling scores": -k - 1.0, "ties": -(k // 3) - 1.0, "any scores": -float(rng.randint(1, 12))}[kind]
                names.append(p)
        data = message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))), *[(1, message((1, p.encode()), (2, s))) for p, s in pieces.items()], (2, message((3, 2))), (3, message((3, 1), (4, 0))))
        own = sp.Encoder(sp.Model(data))
        for _ in range(20):
            text = "".join(rng.choices("abc xy", k=rng.randint(1, 25)))
            want = []
            for p in sp.merge(own.model, "▁" + text.replace(" ", "▁")):
                i = own.model.ids.get(p, own.model.unknown)
                if i != own.model.unknown or want[-1:] != [i]:
                    want.append(i)
                long += len(p) > 1
            assert own.encode_batch([text])[0].tolist() == want, (pieces, text)
        for a in own.orderly:
            for b in own.orderly:
                two = [own.model.pieces[a], own.model.pieces[b]]
                assert own._beside(a, b) == (sp.merge(own.model, "".join(two)) == two), (pieces, two)
    assert long > 1000


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_is_viterbi():
    """A unigram vocabulary written down by hand, against all segmentations."""
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.6, "ab": -3.9, "aba": -4.2, "ba": -4.0, "▁ab": -4.4, "bb": -6.5, "c": -3.1}
    data = message((1, message((1, b"<unk>"), (2, 0.0), (3, 2))), *[(1, message((1, p.encode()), (2, s))) for p, s in pieces.items()], (2, message((3, 1))), (3, message((3, 1), (4, 0))))
    own = sp.Encoder(sp.Model(data))
    names = own.model.pieces

    def best(word):
        found = {0: 0.0}
        for i in range(1, len(word) + 1):
            options = [found[j] + pieces[word[j:i]] for j in range(i) if word[j:i] in pieces]
            if word[i - 1] not in pieces:
                options.append(found[i - 1] + own.model.unknown_score)
            found[i] = max(options)
        return found[len(word)]

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("abbac ", k=rng.randint(1, 12)))
        ids = own.encode_batch([text])[0].tolist()
        marked = "▁" + text.replace(" ", "▁")
        assert "".join(names[i] for i in ids) == marked
        assert sum(pieces[names[i]] for i in ids) == pytest.approx(sum(best(w) for w in own.words_of(text)))
    assert own.encode_batch(["axya"])[0].tolist() == [names.index("▁a"), 0, names.index("a")]  # characters that are no pieces fuse


def test_unsupported_models():
    for data in (message((2, message((3, 3)))), message((3, message((4, 1)))), message((3, message((2, b"x"), (4, 0))))):
        with pytest.raises(ValueError):
            sp.Model(data)


def test_encode_and_decode_tables(library, spark, edge, nothing, tmp_path):
    model = sp.read_model(spark)
    assert sp.read_model(spark, f"file://{MODEL}") == model
    out = sp.encode(edge, model, ["doc_id", "kept"])
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in edge.collect())
    assert out.filter("NOT round_trip").count() == 0
    back = sp.decode(out, model, ["doc_id"])
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in edge.collect())
    assert sp.decode(out.withColumn("ids", F.lit(None).cast("array<int>")).limit(1), model, ["doc_id"]).first().text is None
    assert sp.encode(nothing, model, ["doc_id"]).collect() == []


# training order


@pytest.fixture(scope="module")
def table(spark, edge, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("order"))
    edge.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_slots_are_a_permutation_of_the_stream(spark, table):
    found, n = to.sequences(table, key=9, sequence=64)
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    rows.sort(key=lambda r: (r.part, r.place))
    stream = b"".join(bytes(r.ids[: r.used]) for r in rows)
    docs = table.select("doc_id", "text").collect()
    assert stream == b"".join((r.text or "").encode() + b"\xff" for r in docs)
    assert all(len(r.ids) == 64 and set(r.ids[r.used :]) <= {to.PAD} for r in rows)
    starts = np.cumsum([0] + [len((r.text or "").encode()) + 1 for r in docs])
    at = 0
    for r in rows:
        doc = docs[int(np.searchsorted(starts, at, side="right")) - 1].doc_id
        assert r.first_id == (-1 if doc is None else doc)
        at += r.used
    assert [r.slot for r in rows] != sorted(r.slot for r in rows)
    again = {(r.slot, bytes(r.ids)) for r in to.sequences(table, key=9, sequence=64)[0].collect()}
    assert again == {(r.slot, bytes(r.ids)) for r in rows}


def test_shards_have_a_fixed_stride_and_can_be_resumed(spark, table, tmp_path):
    found, n = to.sequences(table, key=9, sequence=64)
    path = f"{tmp_path}/shards"
    to.write_shards(found, n, "file://" + path, sequence=64, shard=100)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    size = to.stride(64)
    assert [os.path.getsize(f"{path}/{f}") for f in files] == [size * min(100, n - 100 * i) for i in range(-(-n // 100))]
    want = {r.slot: bytes(r.ids) for r in found.collect()}
    with open(f"{path}/{files[2]}", "rb") as f:  # one record, straight from its place
        f.seek(17 * size)
        record = f.read(size)
    head = np.frombuffer(record[: to.HEADER.itemsize], to.HEADER)[0]
    assert head["slot"] == 217 and record[to.HEADER.itemsize : -1] == want[217]
    back = to.read_shards(spark, "file://" + path, sequence=64)
    assert {r.slot: bytes(r.ids) for r in back.collect()} == want
    assert to.read_shards(spark, "file://" + path, sequence=64, from_slot=n - 5).count() == 5


def test_ids_of_two_bytes(spark, tmp_path):
    spark.createDataFrame([(i, list(range(i, i * 300, 7))) for i in range(20)] + [(50, None), (51, [])], "doc_id long, ids array<int>").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    found, n = to.sequences(df, key=1, ids_col="ids", width=2, end=65535, pad=65534, sequence=32)
    to.write_shards(found, n, f"file://{tmp_path}/out", sequence=32, width=2, shard=8)
    rows = to.read_shards(spark, f"file://{tmp_path}/out", sequence=32, width=2).collect()
    got = Counter(x for r in rows for x in np.frombuffer(bytes(r.ids), "<u2")[: r.used].tolist())
    want = Counter(x for r in df.collect() for x in [*(r.ids or []), 65535])
    assert got == want and len(rows) == n


def test_nothing_and_changed_input(spark, nothing, edge):
    found, n = to.sequences(nothing, key=1)
    assert n == 0 and found.collect() == []
    any_text = F.udf(lambda: "x" * random.SystemRandom().randrange(100_000)).asNondeterministic()
    changing = edge.select("doc_id").withColumn("text", any_text())
    with pytest.raises(Exception, match="other rows"):
        to.sequences(changing, key=1)[0].collect()
