"""Each operator on small fixtures: brute force, round trips, and the awkward rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from rankloom.llm import bpe, chat_format, fingerprints, license_scan, mixing, neardup, quality_model, quality_rules, queries, token_rollups, token_store
from rankloom.llm.storage import new_path
from tests.compare import assert_same, connect

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n_words string, score string, row string"
AWKWARD = [
    (1, "alpha beta gamma delta " * 30, "en", "a", 1, "x", "x", "x", "x"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "x", "x", "x"),
    (4, "  \n\t ", "de", None, 5, "x", "x", "x", "x"),
    (5, "alpha beta gamma delta " * 30, "en", "b", 1, "x", "x", "x", "x"),
    (5, "alpha beta gamma delta " * 30, "en", "b", 1, "x", "x", "x", "x"),
    (None, "one two", "en", "a", 7, "x", "x", "x", "x"),
    (6, "long " * 40_000, "en", "a", 9, "x", "x", "x", "x"),
    (7, "Ünïcode \u001c ΑΣ <|endoftext|> é 日本 🎉", "fr", "", 2, "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (6, 0, 1), (6, 1, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def texts(sf_dir):
    return duckdb.execute(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.ORACLE_SQL[name]).df())


# ---- awkward rows and empty tables ----------------------------------------------------


def runs(labels):
    return {
        "license": lambda d: license_scan.scan(d),
        "mix": lambda d: mixing.mix_plan(mixing.narrow(d)),
        "dedup": lambda d: neardup.near_duplicates(d),
        "fingerprints": lambda d: fingerprints.fingerprinted(d),
        "model": lambda d: quality_model.score_documents(d, labels),
        "rules": lambda d: quality_rules.apply_rules(d),
        "bpe": lambda d: bpe.encoded_digests(d, TOKENIZER),
    }


@pytest.mark.parametrize("name", ["license", "mix", "dedup", "fingerprints", "model", "rules", "bpe"])
def test_one_row_for_every_row_whatever_it_holds(awkward, nothing, labels, name):
    run = runs(labels)[name]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in run(awkward).collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in AWKWARD)
    assert run(nothing).collect() == []


def test_filters_keep_columns_and_pass_clashing_names(spark, awkward, nothing, labels):
    for d in (awkward, nothing):
        for out in (quality_model.keep_good(d, labels, threshold=0.0), quality_rules.filter_documents(d), neardup.drop_near_duplicates(d), mixing.mix_documents(d)):
            assert out.dtypes == d.dtypes
            out.collect()
    assert quality_model.keep_good(awkward, labels, threshold=0.0).count() == len(AWKWARD)
    assert sorted(r.doc_id or 0 for r in neardup.drop_near_duplicates(awkward).collect()) == [0, 1, 2, 3, 4, 6, 7]


# ---- license scans ---------------------------------------------------------------------


def test_license_by_brute_force(spark):
    rng = random.Random(3)
    bodies = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    docs = []
    for _ in range(60):
        words = rng.choice(bodies).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        docs.append("Some words before.\n" * rng.randint(0, 2) + " ".join(words) + "\nand after" * rng.randint(0, 2))
    t = license_scan.default_templates()
    for d in docs:
        best = (0.0, None)
        words = license_scan.normal_words(d)
        for x in t.known:
            parts = [license_scan.normal_words(u) for u in license_scan.units(d)] + [words[max(i, 0) : i + x.size + 1] for i in range(-x.size, len(words))]
            for part in parts:
                g = license_scan.bigrams(part)
                dice = 2 * (g & x.grams).total() / (g.total() + x.size) if g else 0
                if dice >= 0.8 and (-dice, x.name) < (-best[0], best[1] or "~"):
                    best = (dice, x.name)
        assert t.best(d)[:2] == (best[1], best[0])


def test_license_in_comments_wrapped_and_inside_lines():
    t = license_scan.default_templates()
    full = license_scan.TEMPLATES["MIT"][-1].split()
    wrapped = "\n".join("# " + " ".join(full[i : i + 9]) for i in range(0, len(full), 9))
    assert t.best("import os\n" + wrapped + "\ndef run(): pass\n" * 30)[:2] == ("MIT", 1.0)
    notice = license_scan.TEMPLATES["MPL-2.0"][0]
    assert t.best("Some prose before it. " * 5 + notice + " And more prose behind, on the same line. " * 5)[:2] == ("MPL-2.0", 1.0)
    for name in ("ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"):
        assert t.best("/* " + license_scan.TEMPLATES[name][-1].replace(" the ", " the\n * ") + " */ int x;")[0] == name
    assert t.best("the license of this software and the terms of the use " * 200)[0] is None


# ---- mixing ----------------------------------------------------------------------------


def fill(sizes, weights, budget):
    """Clamp and share again until nothing is above its clamp."""
    target, free, rest = {}, set(sizes), budget
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / total for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_targets_equal_iterated_filling_and_taken_words_come_near(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", "e", None]), rng.randint(0, 300)) for i in range(4000)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(s for s in sizes if s) + [None]
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * want[s]
        assert abs(sum(r.repeats * r["size"] for r in own) - want[s]) <= 300
    assert max(r.repeats for r in got) <= 2 and len(got) == 4000


def test_equal_rows_are_decided_one_by_one(spark):
    rows = [(1, "a b c", "s")] * 1000 + [(2, "x", "t")] * 10 + [(None, "q r", None)] * 7 + [(3, "", "s")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(mixing.narrow(docs)).collect()
    assert len(plan) == len(rows)
    for s in ("s", "t", None):
        own = [r for r in plan if r.source == s]
        assert abs(sum(r.repeats * r["size"] for r in own) - own[0].target) <= max(r["size"] for r in own)
        assert len({r.repeats for r in own if r["size"]}) <= 2 >= max(r.repeats for r in own)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sorted((r.source or "", len((r.text or "").split())) for r in mixed.collect() if r.text) == sorted((r.source or "", r["size"]) for r in plan for _ in range(r.repeats) if r["size"])


def test_equal_rows_by_the_sql(spark, tmp_path):
    rows = [(i % 7, "w " * (i % 7 % 4 + 1), "ab"[i % 7 % 2]) for i in range(700)] + [(99, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(queries.op2_mix_sources(spark, str(tmp_path)).toPandas(), c.execute(queries.ORACLE_SQL["op2_mix_sources"]).df())


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    assert abs(mixing.mix_documents(docs).count() - 300) <= 2


# ---- token store -----------------------------------------------------------------------


def test_store_round_trip(spark, awkward, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    for docs in (awkward, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        folder = new_path(spark, "store")
        token_store.write_store(docs, folder, TOKENIZER)
        order = sorted(((r.doc_id is not None, r.doc_id or 0), library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
        digests = sorted(token_store.read_digests(spark, folder).collect(), key=lambda r: r.start)
        at = 0
        for ((known, doc_id), ids), r in zip(order, digests, strict=True):
            assert (r.doc_id, r.start, r.n_tokens) == (doc_id if known else None, at, len(ids))
            at += len(ids)
            if known and doc_id != 5:
                assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        back = {r.doc_id: r.ids for r in token_store.read_ids(spark, folder).collect()}
        assert all(back[d if k else None] == ids for (k, d), ids in order)


def test_encoder_equals_library_on_odd_texts():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(TOKENIZER), token_store.library_encoder(TOKENIZER)
    rng = np.random.default_rng(5)
    bits = [*map(chr, range(128)), "\x85", "\xa0", "\u3000", "\u2028", "\u0308", "e\u0301", "É", "Σ", "ΟΔΟΣ", "İ", "ß", "中文", "٣", "🎉", "it's", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "Word", "  ", "\n"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "<|endoftext|>", "<|endoftext|><|startoftext|>", "a<|endoftext|>b", "".join(map(chr, range(128))), "x" * 100_000, "é" * 50_000 + " \u0308a"]
    for some in (texts, [t for t in texts if "<|" not in (t or "")], [None], [""], []):
        ids, per_doc = encoder.encode(some, 1)
        want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in some]
        assert ids.tolist() == [i for w in want for i in w] and per_doc.tolist() == list(map(len, want))


def test_empty_store(spark, nothing):
    folder = new_path(spark, "store")
    token_store.write_store(nothing, folder, TOKENIZER)
    assert token_store.read_digests(spark, folder).collect() == []


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 400):
        counts = rng.integers(1, 10_000, n)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        bits = token_store.code_lengths(counts, 40)
        assert (bits * counts).sum() == cost or n == 1
        assert (2.0 ** -bits).sum() <= 1
    steep = np.array([2**i for i in range(30)])
    assert token_store.code_lengths(steep, 8).max() == 8 and (2.0 ** -token_store.code_lengths(steep, 8)).sum() <= 1


def test_blocks_decode_alone():
    rng = np.random.default_rng(2)
    ids = np.arange(300)
    book = token_store.Codebook(ids, token_store.code_lengths(rng.integers(1, 1000, 300)))
    parts = [rng.integers(0, 300, n) for n in (0, 1, 256, 257, 3000)]
    packed = [book.pack(p) for p in parts]
    together = book.unpack([p for p, _ in packed], [c for _, c in packed], np.array(list(map(len, parts))))
    assert (together == np.concatenate(parts)).all()
    assert (book.unpack([packed[3][0]], [packed[3][1]], np.array([257])) == parts[3]).all()


# ---- near-duplicates -------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d, _ in rows}
    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return {d: (len(sets[d]), label[d]) for d, _ in rows}


def near_copies(n, seed):
    """Families of edited copies, from two to long lists, with shared passages and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 40, 120, 200]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows[:n]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rows = near_copies(420, width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_all_documents_by_brute_force(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(neardup, "HOT_LIST", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_near_dedup(spark, sf).collect()}
    assert got == brute_components(texts(sf), 3, 85)


def test_block_pairs_equal_set_arithmetic():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(20, 50))), dtype=np.uint64) for _ in range(40)]
    side, cid = np.array([i % 2 for i in range(40)]), np.arange(40)
    got = {tuple(p) for p in neardup._block_pairs(side, cid, cid, sets, 60)}
    want = {(i, j) for i in range(0, 40, 2) for j in range(1, 40, 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and want


# ---- fingerprints ----------------------------------------------------------------------


def test_likeness_is_that_of_the_paragraph_sets():
    rng = random.Random(6)
    pairs = []
    for _ in range(200):
        a = {rng.getrandbits(48) for _ in range(rng.choice([0, 1, 10, 300]))}
        b = {x for x in a if rng.random() < 0.7} | {rng.getrandbits(48) for _ in range(rng.choice([0, 2, 50]))}
        pairs.append((a, b))
    arrays = [[np.array(list(s), dtype=np.uint64) for s in side] for side in zip(*pairs)]
    for (x, y), (a, b) in zip(fingerprints.differences(*arrays), pairs):
        assert set(x.tolist()) == a - b and set(y.tolist()) == b - a


def test_folding_is_sketching_at_the_smaller_size():
    keys = np.array([random.Random(1).getrandbits(48) for _ in range(50)], dtype=np.uint64)
    owner, sizes = np.zeros(50, np.int64), [np.array([n]) for n in (64, 8)]
    large, small_ = (fingerprints.Sketches(n, keys, owner) for n in sizes)
    f = fingerprints.folded(large, 8)
    assert (f.count == small_.count).all() and ((f.sums ^ small_.sums) & np.uint64(fingerprints.MASK) == 0).all() and (f.checks == small_.checks).all()


def test_published_strings_tell_every_difference():
    rng = random.Random(12)
    for n, m in ((0, 0), (0, 3), (1, 1), (5, 400), (300, 310), (40, 1)):
        common = {rng.getrandbits(48) for _ in range(min(n, m) // 2)}
        a = common | {rng.getrandbits(48) for _ in range(n - len(common))}
        b = common | {rng.getrandbits(48) for _ in range(m - len(common))}
        prints, _ = fingerprints.fingerprints_of([np.array(list(s), dtype=np.uint64) for s in (a, b)])
        x, y = (fingerprints.base64.b64encode(p).decode() for p in prints)
        only_a, only_b = fingerprints.fingerprint_differences(x, y)
        assert set(only_a.tolist()) == a - b and set(only_b.tolist()) == b - a
        assert fingerprints.fingerprint_likeness(x, y) == (len(a & b) / len(a | b) if a | b else 1.0)


def test_ids_may_be_strings(spark):
    rows = [(f"k{i:03d}", f"text {i}\nline") for i in range(40)] + [(None, "last"), ("k007", "again")]
    got = fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))
    want = [(d, hashlib.sha256(fingerprints.edited_text(t, n).encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1])]
    assert sorted((r.doc_id or "", r.edited_sha256) for r in got) == sorted((d or "", x) for d, x in want)


def test_fingerprints_of_all_documents(spark, sf_dir):
    got = {r.doc_id: r for r in fingerprints.fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    rows = texts(sf_dir)
    following = {d: e for (d, _), (e, _) in zip(rows, rows[1:] + rows[:1])}
    same = {}
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        a, b, c = (set(fingerprints.digests(x)) for x in (t, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert set(fingerprints.listed(r.fingerprint).tolist()) == a and set(fingerprints.listed(r.edited_fingerprint).tolist()) == b
        assert fingerprints.fingerprint_likeness(r.fingerprint, r.edited_fingerprint) == r.near_edited
        assert fingerprints.fingerprint_likeness(r.fingerprint, got[following[d]].fingerprint) == r.near_next
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert same.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(same.values())) == len(same)


# ---- quality model and rules -----------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_quality_model(spark, sf).collect()}
    rows = duckdb.execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in rows)
    held = [(got[d].predicted, q) for d, q in rows if got[d].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def plain_features(text):
    """Feature ids and shares of a document, word by word."""
    tokens = (text or "").encode().split()
    share, size = {}, max(1, 2 * len(tokens) - 1)
    for t in tokens:
        ids, _ = quality_model.features([t])
        for i in ids.tolist():
            share[i] = share.get(i, 0) + 1 / size / len(ids)
    for a, b in zip(tokens, tokens[1:]):
        h = np.array([quality_model.xxhash.xxh3_64_intdigest(x) for x in (a, b)], dtype=np.uint64)
        i = int(quality_model.pair_ids(h)[0])
        share[i] = share.get(i, 0) + 1 / size
    return share


def test_folded_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    n = quality_model.BUCKETS + (1 << quality_model.PAIR_BITS)
    vectors, out, bias = rng.normal(size=(n, quality_model.DIM)), rng.normal(size=(2, quality_model.DIM)), rng.normal(size=2)
    model = quality_model.Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])
    docs = ["a b a b c", "one", "", None, "Wörter und wörter und Wörter " * 50]
    bags = quality_model._Bags(docs)
    for text, got in zip(docs, model.scores(docs)):
        share = plain_features(text)
        z = out @ sum((s * vectors[i] for i, s in share.items()), np.zeros(quality_model.DIM)) + bias
        assert got == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-5)
        ids, shares = bags.bag(text)
        assert dict(zip(ids.tolist(), shares.tolist())) == pytest.approx(share, abs=1e-6)


def test_a_step_goes_against_the_gradient_of_the_loss():
    rng = np.random.default_rng(5)
    vectors, out, bias = rng.normal(size=(6, 3)), rng.normal(size=(2, 3)), rng.normal(size=2)
    ids, shares, label, h = np.array([1, 4, 5]), np.array([0.5, 0.3, 0.2]), 1, 1e-6
    loss = lambda v, o, b: -np.log(quality_model.forward(v, o, b, ids, shares)[1][label])
    slopes = []
    for k, x in enumerate((vectors, out, bias)):
        slope = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            moved = [y.copy() for y in (vectors, out, bias)]
            moved[k][at] += h
            slope[at] = (loss(*moved) - loss(vectors, out, bias)) / h
        slopes.append(slope)
    after = [y.copy() for y in (vectors, out, bias)]
    quality_model.sgd_step(*after, ids, shares, label, 0.01)
    assert after[1] - out == pytest.approx(-0.01 * slopes[1], abs=1e-6) and after[2] - bias == pytest.approx(-0.01 * slopes[2], abs=1e-6)
    assert after[0] - vectors == pytest.approx(-0.01 / (shares @ shares) * slopes[0], abs=1e-6)


def test_training_is_repeatable_and_ignores_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.train(docs, labels), quality_model.train(docs, flipped)
    assert a.packed() == b.packed()


def test_base_counts_by_plain_python():
    t = "a b c a b c #x\nline\nline\n \nLine é"
    n, chars, symbols, dup, again, lines, capitals = quality_rules.base_counts(t)
    assert (n, symbols, dup, lines, capitals) == (11, 1, 1, 4, 1)
    assert chars == sum(map(len, t.split())) and again == 6


def test_sketches_merge_and_stay_within_their_error(spark):
    rng = random.Random(8)
    values = [rng.randint(0, 5000) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket_low(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v <= r.b + r.b // 128 for r in rows)
    cells = spark.createDataFrame([("en", "s%d" % (i % 3), "m", r.b, 1) for i, r in enumerate(rows)], "lang string, source string, metric string, bucket long, n long")
    q = quality_rules.quantiles(quality_rules.merged(cells, ["lang"]), {"q25": 25, "q75": 75}).first()
    exact = sorted(values)
    assert abs(q.q25 - exact[750]) <= exact[750] / 120 + 1 and abs(q.q75 - exact[2250]) <= exact[2250] / 120 + 1
    assert abs(q["mean"] - sum(values) / 3000) <= sum(values) / 3000 / 120 + 1


def measured_rows(spark, groups, scale=1):
    """Documents past the base rules with all metrics alike, in two sources."""
    rows = [(i, "en", s, 100, v * scale) for s, values in groups.items() for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, v long").withColumn("n_repeat_words", F.lit(0))
    return d.select("*", *[F.col("v").alias(m) for m in quality_rules.METRICS])


def test_small_groups_lean_on_their_language_and_large_ones_on_themselves(spark):
    rng = random.Random(1)
    few, many = [900, 905, 910], [rng.randint(400, 500) for _ in range(2000)]
    other = [rng.randint(880, 920) for _ in range(2000)]
    limits = {r.source: r for r in quality_rules.thresholds(quality_rules.sketches(measured_rows(spark, {"few": few, "many": many, "other": other}))).collect()}
    assert limits["many"].word_length_high < 800 and limits["other"].word_length_low > 500
    # three documents of their own against a hundred of a language of two modes: both modes are inside
    assert limits["few"].word_length_low < 400 and limits["few"].word_length_high > 920


def test_a_metric_on_another_scale_gives_the_same_verdicts(spark):
    rng = random.Random(2)
    groups = {"a": [rng.randint(300, 700) for _ in range(300)] + [4000, 5], "b": [0] * 40 + [3, 900], "c": [100, 2000]}
    out = []
    for scale in (1, 2):
        m = measured_rows(spark, groups, scale)
        rows = quality_rules.judged(m, quality_rules.thresholds(quality_rules.sketches(m))).collect()
        out.append(sorted((r.source, r.doc_id, r.kept) for r in rows))
    assert out[0] == out[1] and 0 < sum(not k for *_, k in out[0]) < 20


def test_rules_keep_clean_documents():
    got = {}
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    sf = "/root/testdata/sf0.01"
    for r in queries.op7_quality_rules(spark, sf).collect():
        got[r.doc_id] = r
    rows = duckdb.execute(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    clean = [got[d] for d, q in rows if q == 1 and not got[d].base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    junk = [got[d] for d, q in rows if q == 0]
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)


# ---- rollups ---------------------------------------------------------------------------


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), token_rollups.SCHEMA)


def test_batches_are_applied_once_and_survive_compaction(spark):
    rows = spark.createDataFrame([("a", "en", 5, 7), ("a", "en", 3, 3), (None, None, 2, 9), ("b", "de", None, 1)], "source string, lang string, n long, m long")
    r = token_rollups.Rollup(spark, new_path(spark, "rollup"))
    assert r.totals().collect() == [] and not r.compact()
    assert r.commit(1, token_rollups.inserts(rows, "v1", "n"))
    assert not r.commit(1, token_rollups.inserts(rows, "v1", "n"))
    assert r.commit(2, token_rollups.revisions(rows, "v1", "n", "m"))
    before = sorted(map(str, r.totals().collect()))
    assert r.compact()
    assert r.committed() == [] and sorted(map(str, r.totals().collect())) == before
    assert not r.commit(2, token_rollups.inserts(rows, "v1", "n"))
    assert r.commit(3, token_rollups.deletes(rows.where("source = 'a'"), "v1", "m"))
    assert r.commit(4, rows.where("false").transform(lambda d: token_rollups.inserts(d, "v1", "n")))
    assert {(t.source, t.docs, t.tokens) for t in r.totals().collect()} == {(None, 1, 9), ("b", 1, 1)}


def test_a_late_batch_is_applied_after_a_compaction(spark):
    r = token_rollups.Rollup(spark, new_path(spark, "rollup"))
    for batch in (1, 3):
        assert r.commit(batch, changes(spark, ("s", "en", "v", 1, 10)))
    assert r.compact()
    assert r.commit(2, changes(spark, ("s", "en", "v", 1, 10))) and not r.commit(2, changes(spark, ("s", "en", "v", 1, 10)))
    assert not r.commit(3, changes(spark, ("s", "en", "v", 1, 10)))
    assert [(t.docs, t.tokens) for t in r.totals().collect()] == [(3, 30)]
    assert r.compact() and r.committed() == [] and [t.docs for t in r.totals().collect()] == [3]


def test_of_two_writers_of_one_batch_one_is_told_that_it_lost(spark, monkeypatch):
    folder = new_path(spark, "rollup")
    first, second = token_rollups.Rollup(spark, folder), token_rollups.Rollup(spark, folder)
    real = token_rollups.Rollup._mark

    def late(self, kind, name, content):
        if self is first:  # the other writer lands between writing aside and the mark
            assert second.commit(7, changes(spark, ("s", "en", "v", 1, 10)))
        return real(self, kind, name, content)

    monkeypatch.setattr(token_rollups.Rollup, "_mark", late)
    assert not first.commit(7, changes(spark, ("s", "en", "v", 1, 10)))
    assert [(t.docs, t.tokens) for t in first.totals().collect()] == [(1, 10)]


def test_rollup_query_by_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    words, plain = Tokenizer.from_file(TOKENIZER), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want, seen = {}, set()
    for source, lang, text in duckdb.execute(f"select source, lang, coalesce(text, '') from '{sf_dir}/documents.parquet' order by doc_id").fetchall():
        if text in seen:
            continue
        seen.add(text)
        for version, n in (("word_bpe_49k", len(words.encode(text, add_special_tokens=False).ids) + 1), ("byte_bpe_50k", len(plain.encode(text, add_special_tokens=False).ids))):
            d, t = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, t + n)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in queries.op8_token_rollups(spark, sf_dir).collect()}
    assert got == want


def test_counts_and_copies_of_awkward_rows(awkward, nothing):
    paths = TOKENIZER, public_tokenizers.path("byte_bpe_50k.tiktoken")
    for hot in (1, 1000):
        rows = token_rollups.with_copies(token_rollups.counts(awkward, *paths), hot).collect()
        assert sorted((r.doc_id or 0, r.copy) for r in rows) == [(0, False), (1, False), (2, False), (3, True), (4, False), (5, True), (5, True), (6, False), (7, False)]
        assert {r.doc_id: (r.word_tokens, r.byte_tokens) for r in rows}[2] == (0, 0)
    assert token_rollups.with_copies(token_rollups.counts(nothing, *paths)).collect() == []


# ---- BPE -------------------------------------------------------------------------------


def test_encoding_and_decoding_equal_the_library(awkward, sf_dir):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(TOKENIZER), bpe.codec(TOKENIZER)
    rng = random.Random(9)
    odd = ["".join(rng.choice("aàb ñé日½'sS!.<|>́　\x1fΣ9ⅣİKª") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t in [x for _, x in texts(sf_dir)] + [r[1] or "" for r in AWKWARD] + odd + ["<|endoftext|>a<|startoftext|>", "ha" * 9000, "!?" * 5000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t).tolist() == ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert codec.digests(t) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_every_pre_token_goes_through_the_transducer_in_bounded_runs(monkeypatch):
    codec = bpe.Codec(TOKENIZER)
    fed, most, real = [], [0], bpe.Transducer.feed

    def feed(self, piece):
        fed.append(piece)
        out = real(self, piece)
        most[0] = max(most[0], len(self.buffer))
        return out

    monkeypatch.setattr(bpe.Transducer, "feed", feed)
    text = "Some words, some WORDS again <|endoftext|> and 12 é " + "long" * 50_000 + " end " * 20_000
    sizes = [len(run) for run in codec.runs(text)]
    words = bpe.pre_tokens("Some words, some WORDS again  and 12 é  end ")
    assert {w.encode() for w in words} <= set(fed) and b"".join(x for x in fed if set(x) <= set(b"long")).count(b"long") == 50_000
    assert max(sizes) <= 2 * bpe.STRETCH and most[0] <= codec.transducer.least + 2 * bpe.SLACK
    from tokenizers import Tokenizer

    assert codec.encode(text).tolist() == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_the_split_of_every_code_point_is_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 20_000):
        text = " ".join(f"a{c}1{c}{c}!" for c in every[at : at + 20_000])
        normal = library.normalizer.normalize_str(text)
        assert bpe.pre_tokens(text) == [x for x, _ in split_of(library, normal)], at


def split_of(library, normal):
    """The library's pre-tokens before they are written in byte symbols."""
    from tokenizers import Regex, pre_tokenizers
    import json

    spec = json.loads(library.to_str())["pre_tokenizer"]
    parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
    first = next(p for p in parts if p["type"] == "Split")
    pattern = first["pattern"].get("Regex") or first["pattern"]["String"]
    return pre_tokenizers.Split(Regex(pattern), first["behavior"].lower(), invert=first["invert"]).pre_tokenize_str(normal)


def test_stretches_are_cut_before_white_space_only():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab é\n\t́'s3") for _ in range(rng.randint(0, 80)))
        parts = [*bpe.stretches(text, 7)]
        assert "".join(parts) == text and all(x[0] in " \n" for x in parts[1:])
        assert [w for x in parts for w in bpe.pre_tokens(x)] == bpe.pre_tokens(text) == [*bpe.each_pre_token(text)]


class Toy:
    """A vocabulary of single letters and random merges."""

    def __init__(self, rng, letters="ab", merges=25, suffix="_"):
        tokens = [c for c in letters] + [c + suffix for c in letters]
        self.merges, self.suffix = [], suffix
        while len(self.merges) < merges:
            a, b = rng.choice([t for t in tokens if not t.endswith(suffix)]), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                self.merges.append((a, b))
        self.ids = {t: i for i, t in enumerate(tokens)}


@pytest.mark.parametrize("seed", range(30))
def test_streaming_equals_merging_the_whole(seed, monkeypatch):
    rng = random.Random(seed)
    toy = Toy(rng)
    monkeypatch.setattr(bpe, "byte_symbols", lambda: tuple("ab"[i % 2] for i in range(256)))
    monkeypatch.setattr(bpe, "SLACK", 8)
    table = bpe.MergeTable(toy)
    for _ in range(20):
        data = bytes(rng.randrange(2) for _ in range(rng.randint(1, 600)))
        whole = table.merged([*(table.inner[b] for b in data[:-1]), table.last[data[-1]]])
        t, out, most = bpe.Transducer(table), [], 0
        for at in range(0, len(data), 5):
            out += t.feed(data[at : at + 5])
            most = max(most, len(t.buffer))
        assert out + t.finish() == whole
        assert most <= t.least + 2 * bpe.SLACK + 8
        assert table._few(list(map(table.inner.__getitem__, data))) == table._many(list(map(table.inner.__getitem__, data)))


def test_decoder_gives_characters_as_soon_as_they_are_whole():
    machine = bpe.ByteTextDecoder()
    assert [machine.feed(bytes([b])) for b in "é🎉".encode()] == ["", "é", "", "", "", "🎉"]
    rng = random.Random(10)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC1]) for _ in range(rng.randint(0, 8)))
        m, cut = bpe.ByteTextDecoder(), rng.randint(0, len(data))
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.finish() == data.decode("utf-8", "replace")
    assert "".join(bpe.codec(TOKENIZER).decoder.text(bpe.codec(TOKENIZER).runs("héllo wörld"))) == "héllo wörld "


# ---- chat ------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(11)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|", "<\\|", "<\\\\|", "|", "<", "\\", "\n", "a", "é🎉", ""]
    rows, want = [], {}
    for c in range(60):
        turns = [(k * 40, rng.choice(["user", "assistant", "assistant", "sys\n<tem\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(1, 30))]
        want[c] = turns
        rows += [(c, *t, "extra") for t in turns]
    rng.shuffle(rows)
    rows += [(100, None, None, None, "x"), (None, 1, "user", "q", "x"), (101, 0, "user", "same", "x"), (101, 0, "user", "same", "x")]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in chat_format.parse_conversations(formatted).collect()}
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert got[c].formatted.count("<|im_start|>") == got[c].formatted.count("<|im_end|>\n") == blocks
    long = [(1, 5, "assistant", "x<|" * 60_000)] + [(2, 0, "user", f"m{i % 7}") for i in range(600)] + [(3, None, "user", "a"), (3, None, "assistant", "b"), (3, None, None, "c")]
    back = {r.conv_id: r for r in chat_format.parse_conversations(chat_format.format_conversations(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))).collect()}
    assert back[1].loss_text == "x<|" * 60_000 and len(back[2].turns) == 600 and sorted(t.text for t in back[3].turns) == ["a", "b", "c"]
    assert [(t.role, t.text) for t in got[100].turns] == [("", "")] and len(got[101].turns) == 2 and len(got[None].turns) == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.parse_conversations(chat_format.format_conversations(empty)).collect() == []


# ---- pipeline --------------------------------------------------------------------------


def stage_by_brute_force(name, rows, sf_dir, spark):
    """What a stage leaves of ``rows`` (doc_id, text, lang, source), as sorted doc_ids."""
    import pandas as pd

    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    if name == "quality_classifier":
        labels = dict(duckdb.execute(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
        known = sorted(((d, t) for d, t, *_ in rows if d in labels and zlib.crc32(str(d).encode()) % 4 != 2), key=lambda r: (hashlib.md5(f"{quality_model.SEED}:{r[0]}".encode()).hexdigest(), r[0]))
        model = quality_model.fit([t for _, t in known], [labels[d] for d, _ in known])
        return sorted(d for d, t, *_ in rows if model.scores([t])[0] >= 0.7)
    if name == "quality_rules":
        return sorted(d for d, k in c.execute(f"select doc_id, kept from ({queries.ORACLE_SQL['op7_quality_rules']})").fetchall() if k)
    if name == "near_duplicates":
        return sorted(d for d, (_, first) in brute_components([r[:2] for r in rows], 5, 80).items() if first == d)
    if name == "mix_sources":
        return sorted(d for d, n, taken in c.execute(f"select doc_id, size, taken from ({queries.ORACLE_SQL['op2_mix_sources']})").fetchall() for _ in range(taken // max(n, 1)))
    return sorted(d for d, *_ in rows)


def test_pipeline_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline
    from rankloom.llm.storage import written
    from tokenizers import Tokenizer

    at = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = at.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in at.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
        out = written(stage(spark, at, sf_dir), name)
        assert sorted(r.doc_id for r in out.collect()) == stage_by_brute_force(name, rows, sf_dir, spark), name
        if i < 4:
            assert out.columns == columns
            at = out
    library = Tokenizer.from_file(TOKENIZER)
    of = {d: t for d, t, *_ in rows}
    assert all(r.ids == library.encode(of[r.doc_id], add_special_tokens=False).ids for r in out.collect())
    final = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in out.collect())


@pytest.mark.parametrize("case", ["awkward", "empty", "no labels"])
def test_pipeline_takes_awkward_tables(spark, awkward, nothing, labels, tmp_path, case):
    import corpus_pipeline

    (nothing if case == "empty" else awkward).write.parquet(f"{tmp_path}/documents.parquet")
    (labels.where("false") if case == "no labels" else labels).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in AWKWARD}
    if case != "awkward":
        assert out.count() == 0


def test_range_numbers_count_the_cuts_below(spark):
    for cuts in ([], [5], [1, 2, 3], list(range(0, 100, 7)), list(range(50))):
        rows = spark.range(-3, 110).select("id", fingerprints._range_number(cuts, F.col("id")).alias("n")).collect()
        assert all(r.n == sum(c < r.id for c in cuts) for r in rows)
