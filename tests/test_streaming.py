"""Streams that are killed and started again."""

from collections import Counter

import pytest
from pyspark.errors import StreamingQueryException

from quarry.rules import PROSE_RULES
from quarry.streaming.scan import stream_secrets, watch_parquet
from quarry.streaming.sinks import first_seen, read_batches, write_batches

SCHEMA = "id long, text string"


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_killed_stream_gives_each_finding_once(spark, tmp_path, when):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    texts = ["mail a@b.net", "a@b.net and c@d.org", "nothing", "c@d.org e@f.com", "10.0.0.1 a@b.net", "e@f.com g@h.net 10.0.0.1"]
    failed = []

    def once(batch, number):
        """The second batch breaks off, before or after its rows are written."""
        if number == 1 and not failed:
            failed.append(number)
            if when == "after":
                batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            raise RuntimeError("killed")
        return batch

    def run():
        stream = first_seen(stream_secrets(watch_parquet(spark, source, spark.createDataFrame([], SCHEMA).schema, 1), "text", PROSE_RULES))
        query = write_batches(stream, out, state, once, availableNow=True)
        query.awaitTermination(60)
        assert query.exception() is None

    for i, text in enumerate(texts[:4]):
        spark.createDataFrame([(i, text)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises((StreamingQueryException, AssertionError)):
        run()
    run()
    for i, text in enumerate(texts[4:], 4):
        spark.createDataFrame([(i, text)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    found = Counter((r["type"], r["data"]) for r in read_batches(spark, out).collect())
    assert found == {("Bare Email", "a@b.net"): 1, ("Bare Email", "c@d.org"): 1, ("Bare Email", "e@f.com"): 1, ("Bare Email", "g@h.net"): 1, ("IPv4", "10.0.0.1"): 1}
    assert failed == [1] and len({r["batch"] for r in read_batches(spark, out).select("batch").collect()}) >= 3
