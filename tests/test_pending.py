from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from triplewright.streaming.pending import events_of, followed

START = datetime(2024, 1, 1)
SCHEMA = "prompt_hash string, kind string, body string, at timestamp"


def test_late_double_and_missing_answers(spark, tmp_path):
    """One file of events is one batch; a last prompt moves the watermark."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def put(*rows):
        events = [(h, kind, body, START + timedelta(seconds=at)) for h, kind, body, at in rows]
        spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sent = stream.where("kind = 'sent'").withColumnRenamed("body", "payload_json")
        answers = stream.where("kind = 'answer'").withColumnRenamed("body", "raw")
        done = followed(events_of(sent, answers), wait=100, keep=1000, delay=0)
        run = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert run.awaitTermination(120) and run.exception() is None
        return sorted((r["prompt_hash"], r["status"], r["attempt"], r["body"]) for r in spark.read.parquet(out).collect() if not r["prompt_hash"].startswith("clock"))

    first = put(
        ("a", "sent", "pa", 0), ("a", "answer", "ra", 5), ("a", "answer", "again", 6),  # double
        ("b", "sent", "pb", 0), ("c", "sent", "pc", 0),
        ("d", "answer", "rd", 1), ("d", "sent", "pd", 2),  # the answer first
        ("e", "answer", "re", 1),  # no prompt
        ("f", "sent", None, 0), ("f", "answer", None, 1),  # an empty prompt, a failed call
        (None, "sent", "none", 0),
    )
    assert first == [("a", "answered", 1, "ra"), ("d", "answered", 1, "rd")]
    second = put(("clock1", "sent", "x", 150), ("a", "answer", "third", 150))
    asked = [("b", "ask", 2, "pb"), ("c", "ask", 2, "pc"), ("f", "ask", 2, None)]
    by_key = lambda rows: sorted(rows, key=lambda r: (r[0], r[1]))
    assert by_key(second) == by_key(first + asked)
    third = put(("b", "answer", "rb", 160), ("clock2", "sent", "x", 400))
    assert by_key(third) == by_key(second + [("b", "answered", 2, "rb"), ("c", "expired", 2, "pc"), ("f", "expired", 2, None)])
    fourth = put(("c", "answer", "rc", 410), ("c", "answer", "more", 411), ("clock3", "sent", "x", 1100))
    assert by_key(fourth) == by_key(third + [("c", "late", 2, "rc"), ("e", "unknown", 0, "re")])
    assert spark.read.parquet(out).where(F.col("status") == "answered").groupBy("prompt_hash").count().where("count > 1").count() == 0
