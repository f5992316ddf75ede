import pytest
from pyspark.sql import functions as F

from scanloom.llm import common, decontaminate, near_dup, pii, substring_dedup, suffix_dedup


def test_only_files_have_places(spark, docs_of):
    docs = docs_of([(1, "a"), (2, "b")])
    assert common.is_file_scan(docs) and common.is_file_scan(docs.filter("doc_id > 1").select("text", F.lit(1).alias("x")).alias("t"))
    for other in (docs.join(docs, "doc_id"), docs.union(docs), docs.repartition(2), docs.join(spark.range(3), F.lit(True)), docs.distinct(),
                  docs.select(F.explode(F.array(F.lit(1), F.lit(2)))), spark.range(2), docs.limit(1), docs.mapInArrow(lambda b: b, docs.schema)):
        assert not common.is_file_scan(other)
        with pytest.raises(ValueError):
            common.row_key(other)
    assert common.keyed(docs.join(spark.range(3), F.lit(True)), doc_id="doc_id").select("row_").distinct().count() == 6


class Unset:
    """A session that names no folder."""

    def __init__(self, master):
        self.sparkContext = self
        self.master, self.conf = master, {}


def test_a_folder_has_to_be_named(monkeypatch):
    monkeypatch.setattr(common, "_own", [])
    for master in ("local[4]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_root(Unset(master))
    common.use_own_folder(Unset("spark://host:7077"))
    assert common._own == []
    common.use_own_folder(Unset("local[4]"))
    assert common.shared_root(Unset("local[2]")) == common._own[0]
    with pytest.raises(ValueError):
        common.shared_root(Unset("spark://host:7077"))


def test_rows_from_a_join_are_the_rows_of_the_file(spark, docs_of, prose):
    """Input that a shuffle deals gives what the file gives, however many partitions the plans that read it come to have."""
    passage = prose(99, 70)
    rows = [(k, prose(k, 60 + k)) for k in range(40)] + [(100 + k, prose(k, 60 + k) + " end") for k in range(20)]
    rows += [(200 + k, f"{prose(300 + k, 30)} {passage} mail to a{k}@example.com") for k in range(10)] + [(300, None)]
    docs = docs_of(rows)
    items = spark.createDataFrame([(1, prose(3, 63)), (2, passage)], "item_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = docs.join(docs.select(F.col("doc_id").alias("i"), F.lit("w").alias("wide")).distinct(), F.col("doc_id").eqNullSafe(F.col("i"))).drop("i", "wide")

        def both(run):
            return [sorted(map(str, run(d).collect())) for d in (docs, wide)]

        for run in (
            near_dup.keep_one, lambda d: decontaminate.keep_clean(d, items), pii.redact, suffix_dedup.without_repeats,
            # which document of a group stands for the others depends on the place of its row
            lambda d: substring_dedup.repeated_passages(d).filter("doc_id < 200").select(F.least("doc_id", "rep_doc_id"), F.greatest("doc_id", "rep_doc_id")),
        ):
            file, joined = both(run)
            assert file == joined and file
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
