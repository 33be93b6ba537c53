"""The stream of new files: state over restarts, equal to the batch answer."""

import random

from pyspark.sql import functions as F

from folioframe.functions.people import parse_name
from folioframe.streaming import running


def test_intake_over_restarts_equals_the_batch_answer(spark, tmp_path):
    turn = random.Random(4)
    rows = [(i, turn.choice([None, "10.1/hot", "10.1/hot", f"10.1/{i % 40}"]), turn.choice([None, " ", "Hot Title", "hot title!", f"Title {i % 50}", f"Own {i}"]), turn.choice(["Stone", "Reed"])) for i in range(400)]
    schema = "entry_id long, doi string, title string, family string"

    def identify(files):
        return files.select("entry_id", F.col("entry_id").alias("ord"), "doi", "title", F.array(parse_name(F.concat(F.lit("Ann "), "family"))).alias("creators"), F.lit(2020).alias("year"))

    def run():
        files = running.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "*.parquet", per_trigger=1)
        running.intake(files, identify, f"file://{tmp_path}/plan", f"file://{tmp_path}/state", '{{ authors max="1" name="family" }}', available_now=True).awaitTermination()
        return {r.entry_id: (r.status, r.match_id, r.reason, r.target) for r in spark.read.parquet(f"{tmp_path}/plan").collect()}

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    for part in range(3):  # each part arrives after the query has ended; state and names go on
        spark.createDataFrame(rows[part * 130 : part * 130 + (130 if part < 2 else 140)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run()
    assert spark.conf.get(setting) == before and run() == found
    key = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    dois, titles, names, want = {}, {}, {}, {}
    for i, doi, title, family in rows:
        reason = "doi" if doi in dois else "title" if key(title) in titles else None
        match = dois.get(doi) if reason == "doi" else titles.get(key(title))
        if not (title or "").strip():
            status = "failed"
        else:
            status = "duplicate" if reason else "organized"
        target = None
        if status == "organized":
            names[family] = names.get(family, 0) + 1
            name = family if names[family] == 1 else f"{family} ({names[family]})"
            target = f"{name}/{name}.pdf"
        want[i] = (status, match, reason, target)
        if doi:
            dois.setdefault(doi, i)
        if key(title):
            titles.setdefault(key(title), i)
    assert found == want
