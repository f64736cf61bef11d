import hashlib
import re

from claimlens.llm import exact


def wanted(rows):
    groups = {}
    for i, t in set(rows):
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(n, []).append((-len(t or ""), i))
    out = set()
    for n, members in groups.items():
        keep = min(members)[1]
        out |= {(i, keep, len(members), i == keep, hashlib.sha256(n.encode()).hexdigest()) for _, i in members}
    return out


def decided(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_matches_brute_force(spark, hard, hard_rows):
    out = decided(exact.DigestIndex(spark, buckets=4).append(hard))
    assert out == wanted(hard_rows)


def test_index_persists_and_later_copies_go(spark, tmp_path, hard, hard_rows):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = decided(index.append(hard))
    later = spark.createDataFrame([(900, hard_rows[0][1]), (901, "quite new"), (902, "quite  new ")], "doc_id long, text string")
    second = {r.doc_id: r for r in exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4).append(later).collect()}
    assert not second[900].kept and second[900].keep_id == 0
    assert second[902].kept and second[901].keep_id == 902
    assert index.entries().count() == len({x[4] for x in first}) + 1


def test_one_file_for_each_bucket_with_more_tasks(spark, tmp_path, monkeypatch):
    frame = type(spark.range(0))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: plain(self, max(n, 40) if by else n, *by))
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=8)
    out = index.append(spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text"))
    assert out.filter("kept").count() == index.entries().count() == 2000
    assert len(list((tmp_path / "index").glob("*.parquet"))) == 8


def test_index_join_reads_buckets_without_shuffling_them(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index.append(docs).count()
    groups = index.entries().select("digest").hint("merge").join(index.entries().select("digest"), "digest", "left_anti")
    assert "Exchange" not in groups._jdf.queryExecution().executedPlan().toString()


def test_rows_repeated_null_ids_and_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "c"), (None, None), (1, "ab")], "doc_id long, text string")
    decisions = exact.DigestIndex(spark, buckets=2).append(docs)
    kept = sorted(((r.doc_id, r.text) for r in exact.deduplicated(docs, decisions).collect()), key=repr)
    assert kept == [(1, "a b"), (None, "c"), (None, None)]
    assert exact.DigestIndex(spark, buckets=2).append(empty).count() == 0


def test_stage_keeps_columns(spark, hard):
    out = exact.deduplicated(hard, exact.DigestIndex(spark, buckets=4).append(hard))
    assert out.columns == hard.columns
    assert out.count() == len({x[1] for x in wanted([(r.doc_id, r.text) for r in hard.collect()])})
