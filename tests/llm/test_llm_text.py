"""Tokens, chat, quality and toxicity against libraries and brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemill.llm import chat, chunk_codec, packing, quality, token_counts, token_files, toxicity
from telemill.llm.tokens import Encoder
from telemill.llm.words import blocks

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, ids string, n_tokens string, kept string, text_bytes string"
ODD = [(1, "Plain text, of two lines.\nAnd more: 12 345 don't!"), (2, None), (3, ""), (None, "no id here"),
       (4, "word " * 12000 + "\n\n  end "), (5, "é" * 300 + "x"), (6, " <|endoftext|> a <|startoftext|>b  <s> </s> "),
       (1, "Plain text, of two lines.\nAnd more: 12 345 don't!"), (7, "\x1c tab\tnbsp\xa0 ▁ \r\n line  İ ß ¡hola! 𝄞"),
       (-8, "a\n\nb \n c  \n"), (9, "nospace" * 900)]


def frame(spark, rows):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def encoded(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


ENCODERS = {path: Encoder(path) for path in (WORD, BYTE)}
PIECES = token_counts.PieceCounter(PIECE)
REFERENCE = {path: Tokenizer.from_file(path) for path in (WORD, BYTE)} | {PIECE: sentencepiece.SentencePieceProcessor(model_file=PIECE)}
texts = st.lists(st.text(st.sampled_from("abcé'sS .,\n\t  \xa0▁12#<|>ÀñΣ́ 日") | st.characters(exclude_categories=["Cs"]),
                         max_size=40), min_size=1, max_size=5)


def block(values):
    batch = pa.RecordBatch.from_arrays([pa.array([v.encode() for v in values], pa.binary())], ["text"])
    return next(iter(blocks([batch], "text")))[1:]


@settings(max_examples=150, deadline=None)
@given(texts, st.sampled_from([WORD, BYTE]))
def test_encoder_equals_library(values, path):
    flat, bounds = ENCODERS[path].encode(*block(values))
    got = [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [REFERENCE[path].encode(v, add_special_tokens=False).ids for v in values]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_piece_counts_equal_library(values):
    values = [v.replace("\x00", "") for v in values]
    assert PIECES.count(*block(values)).tolist() == [len(REFERENCE[PIECE].encode(v)) for v in values]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab cé.\n", max_size=300), min_size=1, max_size=4))
def test_chunks_equal_library(values):
    codec = chunk_codec.ChunkCodec(ENCODERS[WORD], mean_bytes=8)
    flat, bounds = codec.encode(*block(values))
    for value, a, b in zip(values, bounds, bounds[1:]):
        ids = REFERENCE[WORD].encode(value, add_special_tokens=False).ids
        assert flat[a:b].tolist() == ids
        assert codec.decode(ids) == REFERENCE[WORD].decode(ids, skip_special_tokens=False)


def test_forgetting_changes_nothing():
    encoder = Encoder(WORD, limit=3)
    for values in (["one two three four five", "six seven"], ["one two six", "eight"]):
        flat, bounds = encoder.encode(*block(values))
        assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == encoded(WORD, values)


def test_token_counts(odd, nothing):
    got = sorted((tuple(r) for r in token_counts.count_tokens(odd, PIECE, 4096).collect()), key=str)
    model = REFERENCE[PIECE]
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in ODD]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(nothing, PIECE, 4096).count() == 0


def test_codec_digests(odd, nothing):
    tokenizer, want = REFERENCE[WORD], []
    for (i, _), ids in zip(ODD, encoded(WORD, [t for _, t in ODD])):
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, chunk_codec.codec_digests(odd, WORD).collect()), key=str) == sorted(want, key=str)
    assert chunk_codec.codec_digests(nothing, WORD).count() == 0
    ids = chunk_codec.encode(odd, WORD)
    back = {r.doc_id: r.text for r in chunk_codec.decode(ids, WORD).collect()}
    assert back[9] == tokenizer.decode(encoded(WORD, ["nospace" * 900])[0], skip_special_tokens=False) and back[2] == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 10**6))
def test_elias_fano(steps, more):
    values = np.cumsum(np.array(steps, np.int64))
    universe = int(values[-1] if len(values) else 0) + more
    coded = token_files.EliasFano.from_bytes(token_files.EliasFano.build(values, universe).to_bytes())
    assert coded.values().tolist() == values.tolist()
    assert [coded.select(k) for k in range(len(values))] == values.tolist()


def test_token_files(spark, odd, nothing, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "t"), BYTE, 0)
    got = sorted(map(tuple, token_files.read_token_files(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    ids = {i: [*x, 0] for (i, _), x in zip(ODD, encoded(BYTE, [t for _, t in ODD]))}
    at = 0
    for doc_id, start, n, crc in got:
        assert (start, n, crc) == (at, len(ids[doc_id]), zlib.crc32(np.array(ids[doc_id], "<u4").tobytes()))
        at += n
    assert token_files.document_ids(spark, str(tmp_path / "t"), 1) == [ids[1], ids[1]]
    token_files.write_token_files(nothing, str(tmp_path / "n"), BYTE, 0)
    assert token_files.read_token_files(spark, str(tmp_path / "n")).count() == 0


@pytest.mark.parametrize("window", [8, 64])
def test_packing(spark, odd, nothing, window):
    many = frame(spark, ODD + [(100 + i, "the same words here " * (1 + i % 3)) for i in range(90)])
    rows = packing.pack(many, WORD, 1, window).toPandas()
    used = rows.groupby("sequence_id")["length"].sum()
    assert used.max() <= window and (window - used).sum() < window
    rows = rows.sort_values(["sequence_id", "offset"])
    for _, s in rows.groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1].tolist()]
    texts = {i: t for i, t in ODD if i is not None} | {100 + i: "the same words here " * (1 + i % 3) for i in range(90)}
    for doc_id, pieces in rows[rows.doc_id.notna()].groupby("doc_id"):
        ids = encoded(WORD, [texts[int(doc_id)]])[0] + [1]
        copies = 2 if doc_id == 1 else 1
        assert pieces["length"].sum() == copies * len(ids) and (pieces["doc_tokens"] == len(ids)).all()
        for p in pieces.itertuples():
            assert zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert packing.pack(nothing, WORD, 1, window).count() == 0


def test_repeats_respect_the_histogram():
    random.seed(3)
    histogram = np.array([0] + [random.choice([0, 0, 1, 5, 90]) for _ in range(64)])
    recipes = packing.combinations(histogram, 64)
    assert all(sum(r) == 64 for r in recipes)
    used = collections.Counter()
    for recipe, n in zip(recipes, packing.solve_repeats(histogram, recipes)):
        for length in recipe:
            used[length] += n
    assert all(used[k] <= histogram[k] for k in used) and sum(used.values()) > 0.5 * histogram.sum()


CONTROL = "</s>[INST] ok [/INST] <|turn|>user<|text|> <\\|end|> [\\/INST] <s>[[INST]<"


def test_chat(spark):
    rows = [(1, 2, "assistant", CONTROL), (1, 0, "user", CONTROL), (1, 1, "user", None), (1, 3, "assistant", ""),
            (2, None, None, "x"), (2, 0, "assistant", "é𝄞"), (2, 0, "assistant", "é𝄞"), (None, 0, "assistant", "a<|next|>b"),
            (3, 0, "a<|text|>\nb", "t\n")]
    rows += [(9, i, random.Random(i).choice(["user", "assistant"]), f"turn {i} {CONTROL}") for i in range(700)]
    made = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string, spans string")
    formatted = chat.format_conversations(made)
    got = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r for r in formatted.collect()}
    for conv, r in whole.items():
        cut = "".join(r.formatted[s.start:s.start + s.length] for s in r.spans if s.learn)
        assert cut.count("<|turn|>") == 0 and r.formatted.startswith("<|turn|>") and r.formatted.endswith("<|end|>\n")
    assert whole[1].formatted.count("<|turn|>") == 2  # adjacent turns of one role are merged
    assert chat.chat_digests(chat.format_conversations(made.limit(0))).count() == 0
    plan = chat.chat_digests(formatted)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    flags = [False] * len(words)
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            flags[i] = flags[i + 1] = flags[i + 2] = True
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(flags))


def prose(i, n=80):
    r = random.Random(i)
    return " ".join(r.choice("the of river stone under morning light walked slowly home again table window".split())
                    + str(r.randint(0, 400)) * (r.random() < 0.5) for _ in range(n)) + "."


def shout(i, n=80):
    return " ".join(w.upper() + "!!" + "*" * 3 for w in prose(i, n).split())


def test_quality(spark, odd, nothing):
    rows = [(i, prose(i) + "\n" + prose(1000 + i)) for i in range(40)] + [(100 + i, shout(i) + "\n" + shout(1000 + i)) for i in range(40)]
    docs = frame(spark, rows + [(500, prose(1) + "\n" + "\n".join(shout(k) for k in range(6))), (501, "a b c " * 60)])
    labels = spark.createDataFrame([(i, int(i < 100), "x") for i, _ in rows] + [(None, 1, "x"), (3, None, "x")],
                                   "doc_id long, quality int, text string")
    chain = quality.fit_chain(docs, labels)
    judged = {r.doc_id: r for r in quality.judge(docs, chain).collect()}
    assert all(judged[i].kept == (i < 100) for i, _ in rows)
    assert not judged[500].kept and judged[500].content_share < 0.5 and judged[501].base_failed
    assert {r.doc_id for r in quality.keep_good(docs, chain).collect()} == {i for i, r in judged.items() if r.kept}
    assert quality.keep_good(docs, chain).columns == docs.columns
    for made, want in ((odd, ODD),):
        got = quality.judge(made, None).collect()
        assert sorted(tuple(r)[1:6] for r in got) == sorted(base_counts(t or "") for _, t in want)
    assert quality.fit_chain(nothing, labels) is None and quality.judge(nothing, chain).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    chain = quality.Chain(r.normal(size=len(quality.FEATURES)), r.normal(size=(2, 2)))
    bounds = np.array([0, 3, 3, 4, 10])
    features = r.normal(size=(10, len(quality.FEATURES)))
    states = chain.decode(features, bounds)
    score = features @ chain.weights
    for a, b in zip(bounds, bounds[1:]):
        def value(path):
            return sum(score[a + i] * s for i, s in enumerate(path)) + sum(chain.transitions[p, q] for p, q in zip(path, path[1:]))
        if b > a:
            best = max(value([k >> i & 1 for i in range(b - a)]) for k in range(1 << (b - a)))
            assert value(states[a:b].tolist()) == pytest.approx(best)


def test_toxicity(spark, odd, nothing):
    bad = ["moron", "idiots", "clownface"]
    rows = [(i, prose(i, 60) + (" you " + bad[i % 3].title() + ", " + prose(1000 + i, 20) if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert held == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert {r.doc_id for r in toxicity.keep_ordinary(docs, model).collect()} == {i for i in got if not got[i].predicted}
    strange = toxicity.score(odd, model).collect()
    assert len(strange) == len(ODD) and all(0 <= r.score <= 1 for r in strange)
    assert [r.held_out for r in strange if r.doc_id is None] == [False]
    assert toxicity.fit(nothing, labels) is None and toxicity.score(nothing, model).count() == 0
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def brute_score(model, text):
    """By the definition: every window compressed afresh with both dictionaries, no blocks, no memory."""
    gain = []
    for window in re.findall(r"[^\W\d_]+", (text or "").lower()):
        ordinary, toxic = toxicity.Distance(model.ordinary, model.toxic).window(window)
        if ordinary - toxic >= model.least and toxic <= model.longest:
            gain.append(ordinary - toxic)
    x = model.weights @ [1, max(gain, default=0) / 20, np.log1p(len(gain))]
    return 1 / (1 + np.exp(-x))


def test_toxicity_equals_brute_force(spark):
    rows = [(i, prose(i, 40) + (" you moron, scum" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    probe = rows[:12] + [(900, "MORON scums a"), (901, None), (902, ""), (903, "12 moron_scum idiot's")]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, probe), model).collect()}
    assert all(got[i] == pytest.approx(brute_score(model, text)) for i, text in probe)


def test_dictionaries_hold_all_shared_windows(spark):
    rows = [(i, f"alpha Beta gamma word{chr(97 + i)}" if i % 2 else f"Alpha scum other{chr(97 + i)}") for i in range(24)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    assert all(toxicity.spell(w) in model.ordinary for w in ("alpha", "beta", "gamma"))
    assert all(toxicity.spell(w) in model.toxic for w in ("alpha", "scum"))
    assert toxicity.spell("scum") not in model.ordinary and toxicity.spell("wordb") not in model.ordinary
    only = labels.filter("toxic = 1")
    assert toxicity.fit(frame(spark, rows), only) is None
    empty = toxicity.fit(frame(spark, [(1, None), (3, ""), (5, " 1 ")]), labels)
    assert empty is None or empty.weights.shape == (3,)
    texts = frame(spark, [(i, [None, "", "12"][i % 3]) for i in range(12)])
    assert {r.predicted for r in toxicity.score(texts, toxicity.fit(texts, labels)).collect()} <= {0, 1}


def test_model_ignores_held_out_labels(spark):
    rows = [(i, prose(i, 40) + (" moron" if i % 3 == 0 else "")) for i in range(300)]
    docs = frame(spark, rows)
    one = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    other = one.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, one), toxicity.fit(docs, other)
    assert a.key() == b.key()
