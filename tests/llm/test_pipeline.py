"""The pipeline against plain versions of its stages."""

import corpus_pipeline
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from terrasift.llm import toxicity

from .fixtures import SF
from .test_others import brute_spans
from .test_texts import groups, tiling


def test_pipeline_matches_plain_stages(spark, tmp_path):
    """Whole tables, fewer rows: the stages' decisions one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 160")
    docs = docs.union(docs.where("doc_id = 5"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    left = {d: t for d, t in rows.items() if d not in toxic}
    left = {d: left[d] for d, (_, c) in groups(list(left.items()), 5, 80).items() if c == d}
    items = [t.lower().split() for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    fives = [{tuple(i[j : j + 5]) for j in range(len(i) - 4)} for i in items]

    def leaked(text):
        w = text.lower().split()
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        return any(f & own and tiling(w, i, 5) >= 0.5 * len(i) for i, f in zip(items, fives, strict=True))

    left = {d: t for d, t in left.items() if not leaked(t)}
    assert set(found) == set(left)

    from tokenizers import Tokenizer
    from terrasift.llm.bpe import default_path

    ref = Tokenizer.from_file(default_path())
    for d, t in left.items():
        out, at = "", 0
        for start, _, _, end in brute_spans(t):
            if start > at or not start:
                out += t[at:start] + "[SECRET]"
            at = max(at, end)
        assert list(found[d].ids) == ref.encode(out + t[at:], add_special_tokens=False).ids


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = docs.union(spark.createDataFrame([(None, "no id at all", "en", "s", 12), (None, None, None, None, None), (1001, None, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.where("doc_id is null").count() == 2


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_documents_that_share_an_id_are_told_apart(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(0, f"{b} more"), (1, a), (1, b), (2, c), (2, c), (3, d), (3, "short other text"), (3, f"{d} more"), (4, f"{c} more"), (None, a), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    want = [(0, f"{b} more"), (1, a), (2, c), (3, d), (3, "short other text"), (None, a), (5, None), (5, "")]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_stages_carry_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    names = ["score", "predicted", "_toxic", "spans", "_row", "id", "_sha", "carried_1", "key"]
    docs = docs.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names))
    docs = docs.union(docs.where("doc_id = 3").withColumn("text", F.lit("another text of three")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name


def test_contaminated_rows_do_not_take_others_of_their_id_along(spark):
    item = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()[0]
    rows = [(1, item), (1, "clean words only"), (2, f"x {item} y"), (3, "clean"), (None, item), (1, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(1, "clean words only"), (3, "clean"), (None, item), (1, None)], key=str)
