"""Chat formatting, token rollups, BPE, packed ids and substring dedup against plain versions."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import bpe, chat, packing, queries, rollup, substring
from quire.llm.common import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "<|endoftext|> x <|endoftext|><|endof text|>"), (9005, "ab'c" * 4000), (9006, "日本 é́ İ" * 300), (9007, "a\x0bb\x0cc\r\nd")]


@pytest.fixture(scope="module")
def rows(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(250).collect()] + ODD


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_tokens int, ids string")


def test_chat_reads_back_every_turn(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "\\<s>\\\\[INST]"), (1, 4, "tool\n[INST]", "left\nover"),
        (2, 0, "assistant", "[/INST"), (2, 0, "assistant", "[/INST"), (None, 1, None, "x"), (3, 0, "system", ""),
    ]
    df = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, example int")
    examples = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = sorted((r.example, r.n_turns, r.loss_chars > 0) for r in examples.where("conv_id = 1").collect())
    assert shown == [(0, 2, True), (1, 4, True), (2, 5, False)]
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_bpe_equals_the_library(spark, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.digest(bpe.encode_documents(frame(spark, rows), queries.tokenizer("byte_bpe_50k.json"), queries.pattern())).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("leaf", [3, 17, 64])
def test_bpe_tree_on_hard_texts(leaf):
    from tokenizers import Tokenizer

    path, rnd = queries.tokenizer("byte_bpe_50k.json"), random.Random(leaf)
    lib, tree = Tokenizer.from_file(path), bpe.ByteBPE(path, leaf_chars=leaf, pattern=queries.pattern())
    texts = ["x" * 2000, " " * 700, "\n" * 300 + "x", "the" * 400]
    texts += ["".join(rnd.choice(a) for _ in range(rnd.randint(1, 500))) for a in ("ab", "a b", " \n\ta'", "a' strelv'd", "!?'s r", "é ü'", "日本語テ", "  x　", "😀a ", "0123 .") for _ in range(25)]
    for text, ids in zip(texts, tree.encode(texts), strict=True):
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert tree.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_rollup_counts_each_batch_once(spark, rows):
    folder = new_folder(spark, "test")
    ev = spark.createDataFrame(
        [("a", "en", "t", "insert", 5, None), ("a", "en", "t", "insert", 7, 0), ("a", "en", "t", "revise", 9, 7), ("b", None, "t", "insert", 1, 0), (None, "en", "t", None, 4, 0), ("c", "en", "t", "insert", None, 0)],
        "source string, lang string, tokenizer string, kind string, tokens long, prior long",
    )
    r = rollup.Rollup(spark, folder)
    assert r.totals().count() == 0
    assert r.commit("one/1", ev) and not r.commit("one/1", ev)
    assert rollup.Rollup(spark, folder).commit("two", ev.where("source = 'b'").replace("insert", "delete", "kind"))
    assert r.commit("none", ev.limit(0))
    assert sorted((x.source, x.lang, x.n_docs, x.n_tokens) for x in r.totals().collect()) == [("a", "en", 2, 14), ("c", "en", 1, 0)]


def events_of(spark, n):
    return spark.createDataFrame([("a", "en", "t", "insert", n, 0)], "source string, lang string, tokenizer string, kind string, tokens long, prior long")


def total(r):
    return [(x.n_docs, x.n_tokens) for x in r.totals().collect()]


class Died(Exception):
    pass


@pytest.mark.parametrize("step", range(4))
def test_rollup_survives_a_driver_that_dies_at_any_step(spark, monkeypatch, step):
    """Step 0: in the write; 1: before it is published; 2: behind that; 3: with data half written."""
    r = rollup.Rollup(spark, new_folder(spark, "test"))
    r.commit("first", events_of(spark, 5))

    def dies(*args):
        raise Died

    if step == 0:
        monkeypatch.setattr(rollup, "deltas", dies)
    if step in (1, 3):
        monkeypatch.setattr(r, "_publish", dies)
    if step == 3:
        r._fs.mkdirs(r._path("data/half/_temporary"))
    if step == 2:
        assert r.commit("second", events_of(spark, 7))
    else:
        with pytest.raises(Died):
            r.commit("second", events_of(spark, 7))
        assert total(r) == [(1, 5)]
    monkeypatch.undo()
    again = rollup.Rollup(spark, r.folder)
    assert again.commit("second", events_of(spark, 7)) == (step != 2)
    assert total(again) == [(2, 12)] and not again.commit("second", events_of(spark, 7))


def test_rollup_with_two_writers_of_a_batch(spark, monkeypatch):
    r, other = (rollup.Rollup(spark, f) for f in [new_folder(spark, "test")] * 2)
    publish = r._publish

    def late(*args):
        assert other.commit("same", events_of(spark, 7))
        publish(*args)

    monkeypatch.setattr(r, "_publish", late)
    assert r.commit("same", events_of(spark, 7)) and len(r._names("committed")) == 2
    assert total(r) == [(1, 7)] == total(other)
    monkeypatch.undo()
    r.compact()
    assert total(r) == [(1, 7)] and not r._names("committed") and not other.commit("same", events_of(spark, 7))


def test_rollup_compacts_and_survives_it(spark, monkeypatch):
    r = rollup.Rollup(spark, new_folder(spark, "test"))
    r.compact()
    assert total(r) == []
    for n, name in enumerate(("a*b", "a@b", "a_.~?[x]")):
        assert r.commit(name, events_of(spark, n)) and not r.commit(name, events_of(spark, n))
    monkeypatch.setattr(rollup, "removed", lambda *a: (_ for _ in ()).throw(Died()))
    with pytest.raises(Died):  # the base is published, nothing is deleted yet
        r.compact()
    monkeypatch.undo()
    assert total(r) == [(3, 3)] and not r.commit("a@b", events_of(spark, 1))
    r.commit("more", events_of(spark, 10))
    r.compact()
    r.compact()
    assert total(rollup.Rollup(spark, r.folder)) == [(4, 13)] and len(r._names("bases")) == 1
    assert not r.commit("a*b", events_of(spark, 0)) and not r.commit("more", events_of(spark, 1))


def test_rollup_query_equals_plain_counts(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    lib = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    want: dict = {}
    for r in docs:
        n = len(WORD.findall(r.text or ""))
        for name, k in (("words-1", n), ("byte_bpe_50k", len(lib.encode(r.text or "", add_special_tokens=False).ids))) if n else ():
            a, b = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = (a + 1, b + k)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op2_token_rollups(spark, data).collect()}
    assert got == want


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17])
def test_packed_shard_round_trip(bits):
    rnd = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 1000):
        ids, buf = rnd.integers(0, 1 << bits, n).astype(np.uint32), io.BytesIO()
        w = packing.Writer(buf, bits, 64 if bits != 5 else 7)
        w.add(np.array([4, 0, 9]), np.array([0, 1, 0]), np.array([n // 3, 0, n - n // 3]), ids)
        w.close()
        r = packing.Reader(buf)
        assert (r.ids(0, n) == ids).all() and (r.document(2) == ids[n // 3 :]).all() and len(r.document(1)) == 0
        assert r.null.tolist() == [False, True, False]
        for a in range(0, n, 97):
            assert (r.ids(a, min(n, a + 70)) == ids[a : a + 70]).all()


def test_packed_ids_equal_the_library(spark, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    lib, all_rows = Tokenizer.from_file(path), [*rows, (None, "none"), (9001, "twice")]
    folder = new_folder(spark, "test")
    shards = packing.write_shards(frame(spark, all_rows), folder, path, end_id=1, shards=3, block=128)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in packing.read_shards(spark, folder, shards).collect()]
    want, start = [], 0
    for i, t in sorted(all_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert packing.read_shards(spark, folder, packing.write_shards(frame(spark, []), folder, path, 1, 2)).count() == 0


def test_word_encoder_on_odd_words():
    from tokenizers import Tokenizer

    path, rnd = queries.tokenizer("word_bpe_49k.json"), random.Random(1)
    lib, enc = Tokenizer.from_file(path), packing.WordEncoder(path, most=50)
    texts = ["".join(rnd.choice("aA'é́ß \nΣs<|endoftext|>0.,!ÀİŸ") for _ in range(150)) for _ in range(300)]
    for at in range(0, 300, 60):
        ids, per = enc.encode(pa.array(texts[at : at + 60]))
        assert ids.tolist() == [i for t in texts[at : at + 60] for i in lib.encode(t, add_special_tokens=False).ids]
        assert per.sum() == len(ids)


def plain_substrings(rows, k):
    first: dict = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - k + 1) if i is not None else ():
            s = tuple(w[p : p + k])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - k + 1) if i is not None and first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return out


@pytest.mark.parametrize("k", [50, 7])
def test_substrings_equal_plain(spark, rows, k):
    rnd = random.Random(k)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    extra = [(7000 + n, " ".join([*(f"u{n}_{j}" for j in range(rnd.randrange(90))), *base[(a := rnd.randrange(300)) : a + rnd.randrange(20, 120)], *(["z"] * rnd.randrange(120))])) for n in range(60)]
    extra += [extra[0], (None, extra[1][1]), (7000, "other text of the same id " + extra[2][1])]
    all_rows = rows + extra
    key = lambda r: (str(r[0]), *r[1:])
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring.dedup_substrings(frame(spark, all_rows), k).collect()]
    want = plain_substrings(all_rows, k)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[2] for r in want) > 500
    assert substring.dedup_substrings(frame(spark, []), k).count() == 0


def test_ids_that_are_no_numbers(spark):
    """Defined: such an id is null; nothing fails."""
    from quire.llm import lines, nearcopies, quality, simhash

    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("a", text, 1), ("7", text, 1), ("b", "x", 1), (None, None, 1)], "doc_id string, text string, `odd``name` int")
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == {7, None}
    assert sorted(str(r.doc_id) for r in substring.dedup_substrings(docs, 50).collect()) == ["7", "None", "None", "None"]
    assert {r.doc_id for r in lines.dedup_lines(docs).collect()} == {7, None}
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("text IS NOT NULL").count() == 2
    assert quality.train_on(docs, spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int"), 10) is not None
    assert quality.accepted(docs, None).columns == docs.columns
    cut = lines.without(docs, lines.deletions(lines.keyed(docs), new_folder(spark, "test"), 5))
    assert cut.columns == docs.columns and cut.count() == 4
    folder = new_folder(spark, "test")
    shards = packing.write_shards(docs, folder, queries.tokenizer("word_bpe_49k.json"), end_id=1, shards=2)
    assert sorted(str(r.doc_id) for r in packing.read_shards(spark, folder, shards).collect()) == ["7", "None", "None", "None"]


def test_words_that_are_read_otherwise_are_encoded_one_by_one(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    enc, lib = packing.WordEncoder(path), Tokenizer.from_file(path)
    enc.ends = np.zeros_like(enc.ends)  # no token ends a word: the joined form can't be told apart
    text = "The quick brown fox, jumps! over"
    ids, _ = enc.encode(pa.array([text]))
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from quire.llm.common import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(far)
