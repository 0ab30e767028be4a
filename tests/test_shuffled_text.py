"""Lines and records are made where a split is read: the text itself is not shuffled."""

from turnstone.sources import spend as SP
from turnstone.sources import transcripts as ST


def _dealt(plan):
    """The columns that each exchange of a physical plan carries, but for those sent to every reader."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from _dealt(plan.initialPlan())
    elif plan.nodeName() == "Exchange":
        yield {plan.output().apply(i).name() for i in range(plan.output().size())}
    for i in range(plan.children().size()):
        yield from _dealt(plan.children().apply(i))


def test_lines_are_numbered_without_a_shuffle_of_their_text(spark, tmp_path):
    for name, n in (("a.jsonl", 90), ("b.jsonl", 1), ("c.jsonl", 40)):
        (tmp_path / name).write_text("".join(f"{i}{'x' * (i % 7)}\n" for i in range(1, n + 1)))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "60")
    try:
        numbered = ST.number_lines(ST.read_lines(spark, str(tmp_path)))
        got = numbered.collect()
    finally:
        spark.conf.set(key, old)
    assert numbered.columns == ["value", "file", "line_no"] and len(got) == 131
    assert all(r.line_no == int(r.value.rstrip("x")) for r in got)
    assert not [c for c in _dealt(numbered._jdf.queryExecution().executedPlan()) if "value" in c]


def test_records_are_joined_without_a_shuffle_of_their_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h,i\n1,"a\nb"\n2,"open\n\nto the end')
    (tmp_path / "b.csv").write_text('h,i\n')
    records = SP.csv_records(spark, str(tmp_path))
    got = sorted((r.file[-5:], r.record_no, r.record) for r in records.collect())
    assert got == [("a.csv", 0, "h,i"), ("a.csv", 1, '1,"a\nb"'), ("a.csv", 2, '2,"open\n\nto the end'), ("b.csv", 0, "h,i")]
    assert not [c for c in _dealt(records._jdf.queryExecution().executedPlan()) if "value" in c]
