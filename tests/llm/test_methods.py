"""The named methods by themselves, and odd tables through every operator and stage."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import components_of, pairs, shingle_sets

import corpus_pipeline as pipeline
from skeinwork.llm import _store, fingerprints, near_dedup, packing, piece_bpe, quality, secrets, substring_dedup, token_counts, toxicity, vector_dedup
from skeinwork.llm.word_bpe import WordBpe, tokenizer_path

INTERNAL = "_base _spans _assign _access _hex _like _every _before _runs _blocks _score _Version _starts _stops _span_id id key keys row part cell class version set_a set_b text_u next_text range led".split()


def thue_morse(n, a, b):
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a text of 1 MB, ties, repeated rows, repeated ids with other texts, and columns named like internal ones."""
    long = " ".join(f"w{i % 5003}" for i in range(180_000))
    assert len(long) > 1_000_000
    a, b = (" ".join(f"{c}{i}" for i in range(120)) for c in "ab")
    texts = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, a), (4, a), (5, None), (6, ""), (7, " \n "), (None, a), (None, None), (8, long), (9, "password=abcdef123"), (10, a + "\n" + b), (11, "x")]
    rows = [(i, t, "en", "web", len(t or ""), *["z"] * len(INTERNAL)) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in INTERNAL)
    return spark.createDataFrame(rows, schema)


def labels_of(spark, docs):
    return spark.createDataFrame([(r.doc_id, (r.doc_id or 0) % 2, (r.doc_id or 0) % 2) for r in docs.select("doc_id").collect()], "doc_id long, quality int, toxic int")


def test_odd_tables_through_every_operator(spark, odd):
    labels = labels_of(spark, odd)
    operators = {
        "secrets": secrets.secrets, "redact": secrets.redact, "scan": secrets.scan, "quality": lambda d: quality.quality_scores(d, labels), "classify": lambda d: quality.classify(d, labels), "pieces": piece_bpe.piece_codes,
        "counts": token_counts.token_counts, "toxicity": lambda d: toxicity.toxicity_scores(d, labels), "remove": substring_dedup.remove, "near": near_dedup.near_duplicates, "fingerprints": fingerprints.fingerprints,
    }
    for name, operator in operators.items():
        assert len(operator(odd).collect()) == odd.count(), name
        assert operator(odd.where("false")).collect() == [], name
    for name in ("redact", "remove"):
        assert operators[name](odd).columns == odd.columns
    assert packing.pack(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack(odd.where("false")).collect() == [] == substring_dedup.repeats(odd.where("false")).collect()
    assert set(secrets.scan(odd).columns) - set(odd.columns) == {"_spans_"} and set(quality.quality_scores(odd, labels).columns) - set(odd.columns) == {"_score_"}


def test_odd_tables_through_every_stage(spark, odd, monkeypatch, tmp_path):
    labels_of(spark, odd).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(pipeline, "LEAST_QUALITY", 0.0)
    docs = odd
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), odd.select(*pipeline.COLUMNS).schema)
        assert docs.columns == list(pipeline.COLUMNS), name
        assert stage(spark, odd.where("false"), str(tmp_path)).collect() == [], name
    left = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in docs.collect())
    # the texts of id 1 both stay, their near copies 2 to 4 and 10 go or lose their passages, rows without an id stay
    assert [t for i, t in left if i == 1] == ["a0", "b0"] and not {2, 3, 4} & {i for i, _ in left} and len([i for i, _ in left if i == 0]) == 2
    assert pipeline.pack_sequences(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_hashes_tell_thue_morse_words_apart(spark):
    bpe, pieces = WordBpe(tokenizer_path("word_bpe_49k.json")), piece_bpe.PieceBpe(tokenizer_path("piece_bpe_32k.model"))
    words = [w for n in (10, 11) for ab in ("ab", "th", "eq") for w in thue_morse(n, *ab)]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
    assert [r.n_tokens for r in token_counts.token_counts(df).orderBy("doc_id").collect()] == [len(bpe.library.encode(w, add_special_tokens=False).ids) for w in words]
    crc = [zlib.crc32(np.array([*bpe.library.encode(w, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for w in words]
    assert [r.ids_crc32 for r in packing.pack(df).orderBy("doc_id").collect()] == crc
    assert [x.tolist() for x in pieces.encode(words)] == [pieces.library.encode(w) for w in words]
    assert all(r.component_id == r.doc_id for r in near_dedup.near_duplicates(df).collect())


def test_the_agenda_alone_gives_the_librarys_pieces(docs):
    pieces = piece_bpe.PieceBpe(tokenizer_path("piece_bpe_32k.model"))
    assert len(list(pieces.encode([t for _, t in pairs(docs)]))) == docs.count() and pieces.differing == 0


# ---------------------------------------------------------------- 1: entropy


def plain_entropy(text):
    best = 0.0
    for k in range(len(text) - secrets.WINDOW + 1):
        n = Counter(text[k : k + secrets.WINDOW]).values()
        best = max(best, -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n))
    return best


def test_entropy_equals_a_plain_sliding_count(spark):
    rng = np.random.default_rng(1)
    found = ["".join(rng.choice(list(secrets.ALPHABET[:k]), n)) for k, n in ((67, 20), (67, 61), (16, 40), (2, 30), (1, 25), (5, 200))]
    got = spark.createDataFrame([(x,) for x in found], "x string").select(secrets.entropy(F.col("x")).alias("h")).collect()
    assert [r.h for r in got] == pytest.approx([plain_entropy(x) for x in found])


def test_entropy_spans_allow_list_and_counts(spark):
    random = "q7Rz2LmX9vKd4TnWb8Hc5Yp3"
    texts = {
        1: f"a key {random} here", 2: "id 123e4567-e89b-12d3-a456-426614174000 is a uuid", 3: f"example{random}", 4: "zzzzzzzzzzzzzzzzzzzzzzzz1", 5: "some/path/of/plain_words/only/here",
        6: f"token={random}", 7: "0123456789abcdef0123456789abcdef01234567-" + random, 8: f"\U0001f600 {random}",
    }
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1].spans == f"entropy:6:{6 + len(random)}" and got[1].n_entropy == 1 and (got[1].n_assign, got[1].n_access, got[1].n_hex) == (0, 0, 0)
    assert all(got[i].spans == "" for i in (2, 3, 4, 5))
    assert got[6].spans == f"assign:0:{6 + len(random)}" and got[6].n_entropy == 0
    assert got[7].spans == f"hex:0:40,entropy:0:{len(texts[7])}"
    assert got[8].spans == f"entropy:2:{2 + len(random)}"
    assert secrets.redact(spark.createDataFrame([(7, texts[7] + " end"), (1, texts[1])], "doc_id long, text string")).orderBy("doc_id").collect()[0].text == f"a key {secrets.MASK} here"


def test_masks_cut_long_texts_at_the_right_places(spark):
    text = "".join(f"{'é' * (k * 37 % 700)} password=abcdef{k} \U0001f600" for k in range(60))
    want = re.sub(secrets.ASSIGN, secrets.MASK, text)
    assert len(text) > 4 * 4096 and secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == want


# ---------------------------------------------------------------- 2 and 5: classifiers


def auc(scores, labels):
    scores, labels = np.asarray(scores, dtype=float), np.asarray(labels)
    good, bad = scores[labels == 1], scores[labels == 0]
    return float(np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])))


@pytest.mark.parametrize(("module", "label", "least_auc", "least_recall"), [(quality, "quality", 0.98, 0.9), (toxicity, "toxic", 0.95, 0.85)])
def test_held_out_auc_and_recall_of_the_rarer_class(spark, module, label, least_auc, least_recall):
    data = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in module.query(spark, data).where("held_out").collect()}
    rows = [(got[r.doc_id].score, got[r.doc_id].predicted, r[label]) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id in got]
    assert len(rows) > 800 and auc([s for s, _, _ in rows], [y for _, _, y in rows]) >= least_auc
    rare = min((0, 1), key=lambda k: sum(y == k for _, _, y in rows))
    assert np.mean([p == rare for _, p, y in rows if y == rare]) >= least_recall
    assert np.mean([p == 1 - rare for _, p, y in rows if y == 1 - rare]) >= 0.97


def test_label_model_finds_planted_accuracies(spark):
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    hit = (0.8, 0.6, 0.4, 0.7)
    votes = np.stack([np.where(rng.random(len(y)) < np.where(y, p, 0.02), 1, 0) for p in hit], axis=1)
    votes = np.c_[votes, votes[:, 3], -(votes.sum(axis=1) == 0).astype(int)].astype(np.int8)  # a voter that repeats another, and the absence of hits
    model, correlations = toxicity.fit_label_model(votes, 0.2)
    posterior = model.posterior(votes)
    assert auc(posterior, y.astype(int)) > 0.95 and abs(posterior.mean() - 0.2) < 0.06
    assert correlations[3, 4] > 0.9 and abs(correlations[0, 1]) < 0.2
    assert model.weights[3] + model.weights[4] < 1.6 * model.weights[0]  # the repeated voter doesn't count twice
    assert np.all(model.weights[:4] > 0)


def test_discriminant_is_the_difference_of_log_densities(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], rng.integers(5, 60))) for _ in range(80)] + [" ".join(rng.choice(["x1", "y!!", "ZZ"], rng.integers(2, 30))) for _ in range(80)]
    df = spark.createDataFrame([(t, int(k < 80)) for k, t in enumerate(texts)], "text string, label int")
    model = quality.fit(df)
    import pyarrow as pa

    z = (quality.statistics(pa.array(texts)) - model.centre) / model.scale
    want = []
    for k in (0, 1):
        covariance = np.linalg.inv(model.whiten[k].T @ model.whiten[k])
        d = z - model.means[k]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariance), d) - 0.5 * np.linalg.slogdet(covariance)[1])
    odds = (want[1] - want[0] + model.log_odds) / quality.TEMPERATURE
    assert model.score(quality.statistics(pa.array(texts))) == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -60, 60))))


# ---------------------------------------------------------------- 6: packing


def best_fit_decreasing(lengths, capacity):
    rooms = np.zeros(capacity + 1, dtype=np.int64)
    used = 0
    for n in sorted(lengths, reverse=True):
        fits = np.flatnonzero(rooms[n:])
        if len(fits):
            rooms[n + fits[0]] -= 1
            rooms[fits[0]] += 1
        else:
            used += 1
            rooms[capacity - n] += 1
    return used


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_the_program_packs_as_few_sequences_as_best_fit(spark, sf):
    bpe = WordBpe(tokenizer_path("word_bpe_49k.json"))
    n = bpe.count([r.text for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("text").collect()]) + 1
    lengths = [x for k in n.tolist() for x in [4096] * (k // 4096) + ([k % 4096] if k % 4096 else [])]
    histogram = Counter(lengths)
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[int(x)] for x in sizes])
    by_program = sum(k for k, _ in packing.rounded(sizes, left, 4096))
    total = sum(k for k, _ in packing.plan(histogram, 4096))
    assert total <= best_fit_decreasing(lengths, 4096) and by_program > 0.7 * total


def test_plans_of_large_histograms_stay_small():
    rng = np.random.default_rng(6)
    histogram = {int(x): int(k) for x, k in zip(*np.unique(np.minimum(rng.lognormal(5.5, 1.0, 40_000).astype(int) + 1, 4096), return_counts=True), strict=True)}
    many = {x: k * 10**7 for x, k in histogram.items()}
    plan = packing.plan(many, 4096)
    held = Counter()
    for n, one in plan:
        assert sum(x * k for x, k in one.items()) <= 4096
        for x, k in one.items():
            held[x] += n * k
    volume = -(-sum(x * k for x, k in many.items()) // 4096)
    assert held == many and len(plan) < 20_000 and sum(n for n, _ in plan) <= 1.001 * volume


# ---------------------------------------------------------------- 7 and 8: near duplicates


def lines_of(docs):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = []
    for i, t in pairs(docs):
        at = 0
        for line in t.split("\n") if i is not None else []:
            w = re.findall(r"[^\x20\x09-\x0D]+", line.translate(lower))
            if w:
                out.append((i, at, at + len(w), frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])))
            at += len(w)
    return out


def test_paragraph_banding_against_brute_force(spark, docs):
    lines = lines_of(docs)
    holders, parent = {}, {}
    for k, (*_, s) in enumerate(lines):
        for x in s:
            holders.setdefault(x, []).append(k)

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    linked = 0
    for k, (*_, s) in enumerate(lines):
        for j, both in Counter(j for x in s for j in holders[x] if j < k).items():
            if 100 * both >= 80 * (len(s) + len(lines[j][3]) - both):
                linked += 1
                a, b = sorted((find(j), find(k)))
                parent[b] = a
    ids = {}
    for k, (i, *_) in enumerate(lines):
        ids.setdefault(find(k), set()).add(i)
    want = {(i, a, b): min(ids[find(k)]) for k, (i, a, b, _) in enumerate(lines) if len(ids[find(k)]) > 1}
    source = near_dedup.source(docs, "doc_id", "text").where("id is not null and length(text) > 0")
    got = {(r.id, r.start, r.stop): r.first_id for r in substring_dedup.repeated_paragraphs(source, substring_dedup.marks(source).where("not anchor")).collect()}
    assert linked > 100 and set(got) <= set(want)
    recall = sum(k in got for k in want) / len(want)
    print(f"recall of the paragraph banding: {recall:.4f} of {len(want)} paragraphs")
    assert recall >= 0.99


def test_what_remove_leaves(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    short, own = "one short line that many share", [" ".join(f"{c}{i}" for i in range(40)) for c in "qr"]
    rows = [(1, f"startone\n{passage}\nendone\n{short}"), (2, f"starttwo\n{passage}\nendtwo\n{short}"), (3, f"{own[0]} {passage} {own[1]}"), (4, short), (5, None), (2, "another text of the id")]
    got = sorted((r.doc_id, r.text) for r in substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text is not None)
    assert got == sorted([(1, rows[0][1]), (2, f"starttwo\n\nendtwo\n{short}"), (3, f"{own[0]}  {own[1]}"), (4, short), (2, "another text of the id")])


def test_texts_without_a_repeat_are_not_shuffled(spark, monkeypatch):
    """With joins that are too large to broadcast, as on large tables, texts without a repeat move once, to be compared; before, three times."""
    words = [hashlib.md5(str(k).encode()).hexdigest()[:9] for k in range(300 * 800)]
    texts = [" ".join(words[k : k + 800]) for k in range(0, len(words), 800)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, f"{t}\n{passage}" if k in (7, 200) else t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/unlike")
    monkeypatch.setattr(substring_dedup, "reclaim", lambda spark: None)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    try:
        before = shuffled()
        got = dict(substring_dedup.remove(spark.read.parquet(path)).collect())
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == dict(rows) | {200: texts[200] + "\n"}
    size = sum(map(len, texts))
    print(f"{moved} bytes shuffled for {size} of text")
    assert moved < 2 * size


@pytest.mark.parametrize("words", [1, 64, 1 << 18])
def test_a_sifted_join_loses_no_row(spark, monkeypatch, words):
    monkeypatch.setattr(_store, "FILTER_WORDS", words)
    rows = spark.range(100_000).selectExpr("if(id % 9 = 0, null, id) AS id", "cast(id % 7 AS int) AS part", "id AS _WORD")
    table = spark.range(0, 100_000, 50).selectExpr("id", "cast(id % 7 AS int) AS part")
    sifted = _store.sift(rows, table, ["id", "part"])
    assert sifted.columns == rows.columns and sifted.join(table, ["id", "part"]).count() == rows.join(table, ["id", "part"]).count() > 1000
    assert words < 1 << 18 or sifted.count() < 2000
    assert _store.sift(rows, table.limit(0), ["id", "part"]).count() == 0


def test_repeated_ids_keep_all_their_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "c d e"), (5, a)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False)]
    spans = {(r.doc_id, r.first_doc_id, r.removed) for r in substring_dedup.repeats(df).collect()}
    assert spans == {(1, 1, False), (2, 1, True), (3, 1, True), (5, 1, True)}


def test_blocks_give_a_forest(spark):
    texts = [" ".join(f"w{i}" for i in range(200)) + f" end{k}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = df.selectExpr("1L AS key", "id", "id AS component")
    found = near_dedup.verify_blocks(members, df, 85, block=64).collect()
    assert len(found) == 39 and near_dedup.components(spark.createDataFrame(found)).select("component").distinct().count() == 1


def test_stage_of_near_copies_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {i for i, c in components_of(shingle_sets(docs), 80).items() if i == c}
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()} == want


# ---------------------------------------------------------------- 9 and 10


def test_vectors_with_null_and_repeated_ids_and_empty_tables(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, v), (1, w), (2, v), (3, w), (None, v), (4, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    assert vector_dedup.near_duplicates(df.where("false")).collect() == []


def test_tiles_of_many_groups_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 700)] + rng.normal(scale=0.22, size=(700, 24))
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), tile=20).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert near.sum() > 1000 and [got[i] for i in range(len(x))] == near.tolist()


def likeness(a, b):
    unit = re.compile(r"\S+(?:[^\S\n]+\S+){0,15}", re.A)
    a, b = set(unit.findall(a)), set(unit.findall(b))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize(("attempts", "load"), [(3, 12), (3, 400), (0, 12)])
def test_fingerprints_when_peeling_fails(spark, monkeypatch, attempts, load):
    monkeypatch.setattr(fingerprints, "ATTEMPTS", attempts)
    monkeypatch.setattr(fingerprints, "LOAD", load)  # far too many digests for a part: the first larger attempts fail
    texts = {k: "\n".join(f"line {k} {i} {'shared' if i % 2 else k}" for i in range(20 * k)) for k in range(1, 8)}
    rows = sorted(texts.items(), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        assert got[i].near_edited == pytest.approx(likeness(t, t[: len(t) - half] + n[:half])) and got[i].near_next == pytest.approx(likeness(t, n))
    assert all(r.peeled for r in got.values()) if load == 12 and attempts else not all(r.peeled for r in got.values())


def test_fingerprints_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(2, "b b"), (2, "a a"), (None, "n n"), (1, "c c"), (2, "b b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_chars, r.near_next) for r in fingerprints.fingerprints(df).collect())
    assert got == [(0, 3, 0.0), (1, 3, 0.0), (2, 3, 0.0), (2, 3, 0.0), (2, 3, 1.0)]  # b b, b b, a a, c c, n n in turn
    assert fingerprints.fingerprints(df.where("false")).collect() == []
