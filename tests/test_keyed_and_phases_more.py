"""A merge deals whole rows once."""

import re

from sonoshelf.streaming import keyed_table

from .test_keyed_and_phases import CHUNK, told


def test_a_merge_shuffles_rows_once(spark, tmp_path, monkeypatch):
    t = keyed_table.KeyedTable(str(tmp_path / "t"), ["transcript_id", "chunk_index"], replace=["text"], keep_if_null=["speaker"], buckets=4)
    t.create(spark.createDataFrame([(i, 0, f"id{i}", f"t{i}", "s", i % 2 == 0, None) for i in range(50)], CHUNK))
    plans, write = [], t._write
    monkeypatch.setattr(t, "_write", lambda rows, mode: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, mode)))
    new = spark.createDataFrame([(i, 0, "x", f"n{i}", None, None, "now") for i in range(40, 60)], CHUNK.replace("transcript_id long", "transcript_id int"))
    t.merge(new, ["text"])
    assert len(re.findall(r"Exchange hashpartitioning", plans[0])) == 1 and "Join" not in plans[0]
    want = [(i, 0, f"id{i}" if i < 50 else "x", f"t{i}" if i < 40 else f"n{i}", "s" if i < 50 else None, i % 2 == 0 if i < 50 else None, "now" if i >= 40 else None) for i in range(60)]
    assert told(t, spark) == sorted(want)
