"""The registered queries on the smallest tables, and the pipeline's stages next to brute force."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from chalkline.llm import decontaminate, secrets, simhash, toxicity
from chalkline.llm.oracles import ORACLES
from chalkline.llm.packing import CAPACITY
from chalkline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text, size=5):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_check_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op1_repair_ids", "op2_toxicity", "op6_secrets", "op7_simhash_components", "op8_pii", "op10_token_counts"])
def test_one_row_per_document(spark, texts, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_classes_equal_all_pairs(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op7_simhash_components"](spark, SF).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    assert all(prints[i] == simhash.fingerprint(t or "") % 2**64 for i, t in texts.items())
    least = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and least[a] > least[b]:
                    least[a], moved = least[b], True
    assert {i: r.component_id for i, r in rows.items()} == least


def test_secret_digests(spark, texts):
    for r in QUERIES["op6_secrets"](spark, SF).collect():
        base = secrets.base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secrets.written_spans(base).encode()).hexdigest()
        assert {s for s in r.spans.split(",") if not s.startswith("random")} - {""} == set(secrets.written_spans(base).split(",")) - {""}


def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = QUERIES["op2_toxicity"](spark, big).where("held_out").join(labels, "doc_id").collect()
    assert all(toxicity.held_out(r.doc_id) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.98 * len(rows)
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) >= 0.9 * len(toxic)


def test_vectors_reach_their_recall(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in QUERIES["op3_vector_search"](spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k, q in enumerate(ids):
        if q % 50 == 0:
            close = unit @ unit[k]
            close[k] = -2
            hits += len(found[q] & set(ids[np.argsort(-close)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(found)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs before, rows after) per stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        after = spark.read.parquet(f"file://{folder}/{name}")
        out[name] = docs.collect(), after.collect()
        if name != "packing":
            assert after.columns == corpus_pipeline.COLUMNS
        docs = after
    return out


def test_toxic_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if model.score(r.text or "") < 0.3)


def test_near_duplicate_stage(stages):
    """Next to the Jaccard similarity of every pair."""
    before, after = stages["near_duplicates"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    least = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if least[a] > least[b] and near(sets[a], sets[b]):
                    least[a], moved = least[b], True
    assert sorted(r.doc_id for r in after) == sorted(set(least.values()))
    assert len({r.text for r in after}) == len(after) < len(before)


def test_decontamination_stage(stages):
    before, after = stages["decontamination"]
    items = [shingles(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    clean = [r.doc_id for r in before if not any(t and len(t & shingles(r.text)) / len(t) >= 0.8 for t in items)]
    assert sorted(r.doc_id for r in after) == sorted(clean)


def test_secret_stage(stages):
    before, after = stages["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert sorted(texts) == sorted(r.doc_id for r in before)
    for r in before:
        if not secrets.base_spans(r.text or ""):
            assert texts[r.doc_id] == r.text or "[SECRET]" in texts[r.doc_id]
        assert not secrets.base_spans(texts[r.doc_id] or "")


def test_packing_stage(stages):
    before, after = stages["packing"]
    sizes = {}
    for r in after:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.size
    assert sizes == {r.doc_id: len((r.text or "").encode()) for r in before}
    loads = {}
    for r in after:
        loads[r.shard, r.bin] = loads.get((r.shard, r.bin), 0) + r.size
    assert max(loads.values()) <= CAPACITY


def test_run_equals_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages["packing"][1])


def test_stages_with_null_ids_repeats_and_long_texts(spark):
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    plain = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [
        (None, item, "en", "a", 1), (None, plain, "en", None, 2), (None, None, None, None, None), (1, item, "en", "a", 1),
        (1, "one clean text " + plain, "en", "a", 1), (2, "token = abcdefgh12345678", "en", "b", 24), (2, "token = abcdefgh12345678", "en", "b", 24),
        (3, long, "en", "c", 5), (4, long + " end", "en", "c", 5), (5, "", "en", "c", 0), (6, " \n", "en", "c", 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    run = dict(corpus_pipeline.STAGES)
    assert run["toxicity"](spark, docs, SF).count() == len(rows)
    near = [(r.doc_id, r.text) for r in run["near_duplicates"](spark, docs, SF).collect()]
    assert {(None, item), (None, plain), (None, None), (3, long)} <= set(near) and not {4, 6} & {i for i, _ in near}
    clean = [(r.doc_id, r.text) for r in run["decontamination"](spark, docs, SF).collect()]
    assert sorted(clean, key=repr) == sorted([r[:2] for r in rows if r[1] != item], key=repr)
    masked = [(r.doc_id, r.text) for r in run["secrets"](spark, docs, SF).collect()]
    assert len(masked) == len(rows) and masked.count((2, "[SECRET]")) == 2 and (None, None) in masked
    packed = run["packing"](spark, docs, SF).collect()
    assert sum(r.size for r in packed) == sum(len((r[1] or "").encode()) for r in rows)


def test_one_row_of_every_near_duplicate_class(spark):
    """Rows without an id are compared like all others, rows that share an id each for itself, and of repeated rows one stays."""
    text = lambda name, *more: " ".join([*(f"{name}{i}" for i in range(60)), *more])
    rows = [
        (None, text("a")), (None, text("a", "end")), (4, text("a")), (None, text("b")), (None, text("b")), (None, None), (3, ""), (11, "..."),
        (7, text("c")), (7, text("d")), (8, text("e")), (9, text("e", "end")), (9, text("f")), (9, text("f")), (10, text("f", "end")),
        (12, text("g")), (12, text("g")), (12, text("g")), (13, text("h")), (13, text("h", "end")), (14, text("i")), (15, text("i", "end")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, (r.text or "-")[:1]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=repr)
    want = [(None, "a"), (None, "b"), (None, "-"), (7, "c"), (7, "d"), (8, "e"), (9, "f"), (12, "g"), (13, "h"), (14, "i")]
    assert got == sorted(want, key=repr)


def test_contained_items_of_nothing(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert decontaminate.contained_items(empty, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
