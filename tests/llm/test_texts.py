"""SimHash, repeated passages, language, likelihood: against plain Python."""

import hashlib
import json
import math
import uuid
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daybook.llm import components, gated, language, queries, scoring, simhash, substrings


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, distance):
    """The root of each fingerprint, comparing all with all."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_agree_with_spark_hashes(docs, rows, spark):
    got = Counter((r.doc_id, r.fp) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((r[0], signed(fingerprint(r[1]))) for r in rows)
    assert spark.sql("SELECT xxhash64('été x')").first()[0] == signed(xxhash.xxh64_intdigest("été x".encode(), seed=42))


def test_near_duplicates(docs, rows):
    prints = {id(r): fingerprint(r[1]) for r in rows}
    roots = grouped(set(prints.values()), 2)
    smallest = {}
    for r in rows:
        root = roots[prints[id(r)]]
        if r[0] is not None:
            smallest[root] = min(r[0], smallest.get(root, r[0]))
    want = Counter((r[0], smallest.get(roots[prints[id(r)]])) for r in rows)
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.representatives(docs.withColumn("doc", F.lit(1)).withColumn("fp", F.lit(2)))
    assert kept.columns == [*docs.columns, "doc", "fp"]
    found = kept.collect()
    assert len(found) == len(set(roots.values()))
    assert {roots[fingerprint(r.text)] for r in found} == set(roots.values())


@pytest.mark.parametrize("distance,segments,crowd", [(2, 16, 24), (2, 8, 2), (2, 32, 3), (1, 16, 3), (3, 16, 4), (4, 16, 6)])
def test_no_link_is_lost(spark, distance, segments, crowd):
    """Clusters around a few centres, so that cells are crowded."""
    draw = np.random.default_rng(distance)
    prints = set()
    for centre in draw.integers(0, 1 << 63, 5):
        for _ in range(25):
            own = int(centre)
            for bit in draw.integers(0, 64, draw.integers(0, 4)):
                own ^= 1 << int(bit)
            prints.add(own)
    prints |= {0, (1 << 64) - 1, (1 << 64) - 2}
    fps = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.links(fps, distance, segments, crowd)
    assert all((a ^ b).bit_count() <= distance or ((a ^ b) & (2**64 - 1)).bit_count() <= distance for a, b in links.collect())
    want = grouped(prints, distance)
    pairs = {(signed(p), signed(r)) for p, r in want.items()}
    got = dict(components.components(links).collect())
    groups, theirs = {}, {}
    for p in prints:
        groups.setdefault(got.get(signed(p), signed(p)), set()).add(p)
        theirs.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values())) and pairs


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, window=50):
    """What each (doc_id, text) keeps."""
    first, split = {}, {r[:2]: (r[1] or "").encode().split() for r in rows}
    for (doc_id, _), words in split.items():
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                own = tuple(words[i:i + window])
                first[own] = min(first.get(own, doc_id), doc_id)
    found = {}
    for (doc_id, text), words in split.items():
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i:i + window])] < doc_id:
                keep[i:i + window] = [False] * window
        kept = b" ".join(w for w, k in zip(words, keep) if k)
        found[doc_id, text] = (len(words), len(words) - sum(keep), hashlib.sha256(kept).hexdigest(),
                               text if all(keep) else kept.decode())
    return found


@pytest.mark.parametrize("crowd,hot", [(substrings.CROWD, substrings.HOT), (2, substrings.HOT), (2, 2)])
def test_repeated_passages(docs, rows, crowd, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    clashing = docs.withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("_text", F.lit(3)).withColumn("whole", F.lit(4))
    want, found = removed(rows), substrings.remove(clashing.withColumn("before", F.col("text")), crowd=crowd)
    assert {"spans", "whole", "lang"} <= set(found.columns) and "_text" not in found.columns
    got = Counter((r.doc_id, r.before, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found.collect())
    assert got == Counter((*r[:2], *want[r[:2]]) for r in rows)
    assert sum(v[1] > 0 for v in want.values()) > 8


def test_repeated_rows_travel_once(spark, monkeypatch):
    staged, stage = [], substrings.stage

    def counted(df, name):
        found = stage(df, name)
        staged.append((name, found.count()))
        return found

    monkeypatch.setattr(substrings, "stage", counted)
    texts = [(3, "a b c d e f"), (3, "a  b c d e f"), (1, "c d e"), (2, "x c d e y")]
    want = removed(texts, 3)
    strings = []
    for times in (1, 40):
        df = spark.createDataFrame(texts + [texts[0]] * (times - 1), "doc_id long, text string").repartition(3)
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substrings.remove(df, window=3, length=2).collect())
        assert got == Counter((k[0], *v) for k, v in want.items()) + Counter({(3, *want[texts[0]]): times - 1})
        strings.append(dict(staged)["strings"])
    assert strings[0] == strings[1] > 0


def test_small_windows_and_nothing(spark, nothing):
    assert substrings.remove(nothing).count() == 0
    texts = [(3, "a b c d e f"), (1, "c d e"), (2, "x c d e y"), (4, "a a a a a a")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substrings.remove(df, window=3, length=2).collect()}
    assert got == {(k[0], *v) for k, v in removed(texts, 3).items()}


def test_minimisers_are_smallest_hashes_and_move_with_the_text():
    words = [str(i * i % 97).encode() for i in range(200)]
    whole = substrings.minimisers(words, 20, 5)
    assert len(whole) == 181
    for i in (0, 50, 180):
        assert substrings.minimisers(words[i:i + 20], 20, 5)[0] == whole[i]
    assert len(set(whole.tolist())) < 60
    assert len(substrings.minimisers(words[:19], 20, 5)) == 0


def ranked(text, ranks):
    """Plain rank order: by count, then by text."""
    found = Counter()
    for word in language._WORDS.findall((text or "").lower()):
        padded = f" {word} "
        found.update(word)
        found.update(padded[i:i + 2] for i in range(len(padded) - 1))
        found.update(padded[i:i + 3] for i in range(len(padded) - 2))
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], [ord(c) for c in x[0].ljust(3, "\0")]))][:ranks]


def number(run):
    codes = [ord(c) for c in run] + [0, 0]
    return codes[0] << 42 | codes[1] << 21 | codes[2]


def test_language_is_the_least_out_of_place(docs, rows):
    profiles = {"a": "the cat and the hat " * 9, "b": "der die das und der " * 7, "c": "été là où çà " * 5}
    ranks = 30
    own = {k: ranked(v, ranks) for k, v in profiles.items()}
    for _, text, *_ in rows[:75] + rows[-20:]:
        mine = ranked(text, ranks)
        assert language.ranking(*language.counts(text), ranks).tolist() == [number(g) for g in mine]
        cost = {k: sum(abs(i - p.index(g)) if g in p else ranks for i, g in enumerate(mine)) for k, p in own.items()}
        name, score = language.Profiles({k: [number(g) for g in v] for k, v in own.items()}, ranks).name(text)
        if not mine:
            assert (name, score) == ("und", 0.0)
        else:
            assert name == min(cost, key=lambda k: (cost[k], k)) and score == pytest.approx(1 - cost[name] / (ranks * len(mine)))


def test_every_labelled_language_is_learned(spark):
    # A letter of its own for each language.
    texts = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} {chr(0x4E00 + i)}", f"l{i:03}") for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    profiles = language.learn(df)
    assert sorted(profiles) == [lang for _, _, lang in texts]
    assert all(r.lang_pred == r.lang and r.score == 1 for r in language.predict(df, profiles).collect())


def test_learning_sees_only_labelled_rows(docs, nothing):
    profiles = language.learn(docs.select("doc_id", "text", "lang"))
    assert set(profiles) == {"en", "de"} and all(0 < len(p) <= language.RANKS for p in profiles.values())
    named = language.predict(docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), profiles)
    assert named.count() == docs.count() and dict(named.dtypes)["score"] == "double"
    assert {r.lang_pred for r in named.collect()} <= {"en", "de", "und"}
    assert language.learn(nothing) == {} and language.predict(nothing, profiles).count() == 0
    assert {tuple(r) for r in language.predict(docs.select("text"), {}).collect()} == {("und", 0.0)}


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(1)
    weights = {k: (v + draw.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in gated.begin(np.full(200, 0.004), 0.2).items()}
    for name in ("class", "word"):
        weights[name] = np.maximum(weights[name], -3)
    documents = [draw.integers(0, 200, n) for n in (9, 5, 3, 12)] + [np.array([200, 3, 0])]
    lanes = gated.Lanes(documents, 3, 0)
    places = next(lanes.windows(32))
    args = lanes.inputs[places], lanes.starts[places], lanes.targets[places], places >= 0, np.zeros((places.shape[1], gated.HIDDEN), np.float32)
    g, (words, inputs), _ = gated.gradients(weights, *args)
    g["input"] = np.zeros_like(weights["input"])
    g["input"][words] = inputs

    def loss(w):
        states, _ = gated._recur(w, args[0], args[1], args[4])
        return -gated.log_probabilities(w, states[args[3]], args[2][args[3]]).mean()

    for name in weights:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({k: v.astype(np.float64) for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05), name


def test_scores_do_not_depend_on_company_or_windows():
    draw = np.random.default_rng(2)
    weights = {k: (v + draw.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in gated.begin(np.full(500, 0.0015), 0.25).items()}
    documents = [draw.integers(0, 500, n) for n in (1, 100, 33, 2, 64, 31)]
    together = gated.score(weights, documents, 0)
    alone = [gated.score(weights, [d], 0)[0] for d in documents]
    assert together == pytest.approx(alone, rel=1e-4)
    assert len(gated.score(weights, [], 0)) == 0
    # All continuations of one word add up to one.
    every = [np.array([7, w]) for w in range(501)]
    first = gated.score(weights, [np.array([7])], 0)[0]
    assert np.exp(gated.score(weights, every, 0) - first).sum() == pytest.approx(1, rel=1e-3)


@pytest.mark.parametrize("words", [1, 2, 9, 200, 4096, gated.WORDS])
def test_classes_share_out_all_words(words):
    edges, of = gated.layout(words)
    assert edges[0] == 0 and edges[-1] == words and (np.diff(edges) > 0).all()
    assert [int(edges[c]) <= n < int(edges[c + 1]) for n, c in enumerate(of[:-1])] == [True] * words and of[-1] == len(edges) - 1
    assert sum(x.nbytes for x in gated.begin(np.full(words, 0.5 / words), 0.5).values()) <= 1.1 * gated.WEIGHT_BYTES


def test_logits_beyond_what_exponentials_can_hold():
    weights = gated.begin(np.full(300, 0.002), 0.4)
    documents = [np.array([5, 7, 299, 300, 0])]
    weights["word"] += 200
    weights["class"] += 200
    assert gated.score(weights, documents, 0) == pytest.approx(gated.score(gated.begin(np.full(300, 0.002), 0.4), documents, 0), rel=1e-3)


def test_texts_are_counted_and_numbered_many_at_a_time(monkeypatch):
    """One text at a time, through Python's words, took 1,167 CPU seconds a GB with the rest."""
    pa, plain = scoring.pa, scoring.tokens
    texts = ["a b A", None, "", " \t\x0b\n", " lead", "trail \r", "É é\x1cx\x85y \u3000", "b " * 50, "rare b rare", "c a\n\nb"]
    want = [plain((t or "").encode()) for t in texts]
    counts = Counter(w for words in want for w in words)
    head = (scoring.END, b"b", b"a", b"never")
    corpus = scoring.Corpus(sum(counts.values()), len(counts), head, np.array([counts[w] for w in head]))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array([0] * n, pa.int32()), pa.array(texts)],
        ["row", "doc_id", "held_out", "draw", "text"])

    def never(text):
        raise AssertionError("a text by itself")

    monkeypatch.setattr(scoring, "tokens", never)
    monkeypatch.setattr(scoring.gated, "WORDS", 2)
    rare, logs = np.log10(corpus.rare()), corpus.logs()
    for size in (1, 20, 8 << 20):
        monkeypatch.setattr(scoring, "_BYTES", size)
        found = Counter()
        for part in scoring._count([batch.slice(0, 0), batch.slice(0, 4), batch.slice(4)]):
            for word, times in zip(*(c.to_pylist() for c in part.columns)):
                found[word] += times
        assert found == counts
        rows = [row for part in scoring._numberer(corpus)([batch.slice(0, 0), batch.slice(0, 4), batch.slice(4)]) for row in part.to_pylist()]
        for row, words in zip(rows, want, strict=True):
            at = [head.index(w) if w in head else -1 for w in words]
            assert np.frombuffer(row["known"], "<u2").tolist() == [i if 0 <= i < 2 else 2 for i in at]
            assert (row["n_tokens"], row["n_known"]) == (len(words), sum(i >= 0 for i in at))
            assert row["base_score"] == pytest.approx(sum(logs[i] for i in at if i >= 0))
            assert row["in_class"] == pytest.approx(sum(logs[i] for i in at if i >= 2) - rare * sum(not 0 <= i < 2 for i in at))
            assert dict(zip(row["words"], row["times"], strict=True)) == Counter(w for w in words if w not in head)


def test_documents_of_a_task_are_scored_side_by_side():
    """A step of few documents costs nearly as much as one of many."""
    batch = scoring.pa.RecordBatch.from_arrays([scoring.pa.array([np.zeros(3000, "<u2").tobytes()] * 400)], ["known"])
    assert [len(pool) for pool in scoring._pools([batch])] == [400]


def test_gradients_of_words_that_occur_more_than_once():
    draw = np.random.default_rng(4)
    inputs, rows = draw.integers(0, 9, 300), draw.normal(size=(3, 300, gated.HIDDEN)).astype(np.float32)
    words, sums = gated._by_word(inputs, rows)
    assert words.tolist() == sorted(set(inputs.tolist()))
    for word, found in zip(words, sums, strict=True):
        assert found == pytest.approx(rows[:, inputs == word].sum(axis=1).ravel(), abs=1e-4)


@pytest.mark.parametrize("head", [scoring.HEAD, 40])
def test_likelihoods(docs, rows, head):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    found = scoring.likelihoods(docs, held_out, head=head).collect()
    out = {r.doc_id: r.held_out for r in found}
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for r in rows if not out[r[0]] for w in tokens(r[1]))
    total = sum(counts.values())
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens(t))
    want = sorted((str(r[0]), len(tokens(r[1])), sum(w in counts for w in tokens(r[1])), total, base(r[1])) for r in rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)
    assert all(r.score <= 0 for r in found)


def test_the_model_learns_from_every_training_document(docs, rows, monkeypatch, tmp_path):
    trainer, read = scoring._trainer, str(tmp_path)

    def noted(weights):
        run = trainer(weights)

        def noting(batches):
            batches = list(batches)
            with open(f"{read}/{uuid.uuid4()}", "w") as out:
                json.dump([known.hex() for batch in batches for known in batch.column("known").to_pylist()], out)
            return run(batches)
        return noting

    monkeypatch.setattr(scoring, "_trainer", noted)
    scoring.likelihoods(docs, F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False))).count()
    learned = Counter(len(text) // 4 for part in tmp_path.iterdir() for text in json.loads(part.read_text()))
    assert learned == Counter(len(scoring.tokens((r[1] or "").encode())) for r in rows if r[0] is None or r[0] % 10)


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_the_model_beats_single_words_on_held_out_documents(spark, scale, parts):
    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet").repartition(parts)
    found = scoring.likelihoods(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).filter("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print(scale, parts, (found[0] - found[1]) / found[2])
    assert found[0] > found[1]


def test_a_round_that_makes_it_worse_is_left_out(docs, monkeypatch):
    monkeypatch.setattr(scoring, "_gains", lambda old, new: lambda batches: iter([scoring.pa.RecordBatch.from_arrays([scoring.pa.array([-1.0])], ["gain"])]))
    for row in scoring.likelihoods(docs, F.lit(False)).collect():
        assert row.score == pytest.approx(row.base_score, rel=1e-4)


def test_no_bucket_holds_more_windows_than_it_may(spark, monkeypatch, tmp_path):
    """One word repeated has one minimiser and a window for each word."""
    real, noted = substrings._repeats, str(tmp_path)

    def noting(window):
        run = real(window)

        def noted_run(batches):
            batches = list(batches)
            sizes = Counter()
            for batch in batches:
                for least, string in zip(batch.column("least").to_pylist(), batch.column("string").to_pylist()):
                    sizes[least] += string.count(b" ") + 2 - window
            with open(f"{noted}/{uuid.uuid4()}", "w") as out:
                json.dump(max(sizes.values(), default=0), out)
            return run(iter(batches))
        return noted_run

    monkeypatch.setattr(substrings, "_repeats", noting)
    texts = [(n, "of " * (3_000 + n) + f"end {n}") for n in range(40)] + [(50, "of " * 100_000), (51, "and " * 60 + "x"), (52, "y " + "and " * 70)]
    found = substrings.remove(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert max(json.loads(part.read_text()) for part in tmp_path.iterdir()) <= substrings.WINDOWS
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in found}
    assert gone[0] == (3_002, 0) and gone[50] == (100_000, 100_000) and gone[51] == (61, 0) and gone[52] == (71, 70)
    assert all(gone[n] == (3_002 + n, 3_001 + n) for n in range(1, 40))


def test_signs_of_numbers_are_no_letters():
    known = language.Profiles({"de": language.ranking(*language.counts("der die das und"))})
    for text in ("²", "½ ①", "Ⅷ 12 _", "", None):
        assert known.name(text) == (language.UNKNOWN, 0.0)
    assert known.name("ñ der²")[0] == "de"


def test_held_out_languages_are_found(spark):
    named = queries.op3_language(spark, "/root/testdata/sf0.01").filter("held_out").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert named.filter("lang = lang_pred").count() >= 0.98 * named.count()


def test_untrained_model_is_the_unigram_model(docs):
    for row in scoring.likelihoods(docs, F.lit(False), rounds=0).collect():
        assert row.score == pytest.approx(row.base_score, rel=1e-4)


def test_likelihood_of_nothing(nothing):
    assert scoring.likelihoods(nothing, F.lit(False)).count() == 0
