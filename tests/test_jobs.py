"""The two jobs: runs over growing input, reruns, failures between steps, odd rows, their command lines."""

import glob
import json
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import code_mentions, traffic_models
from skylattice.operators import model
from skylattice.plans import standins

SF = "/root/testdata/sf0.001"


@pytest.fixture
def growing(spark, tmp_path):
    """Two halves of the events, and a folder that they come into."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(2):
        events.filter(F.col("event_id") % 2 == k).coalesce(1).write.parquet(str(tmp_path / f"half{k}"))

    def come(k):
        (name,) = glob.glob(str(tmp_path / f"half{k}" / "*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.link(name, tmp_path / "in" / f"half{k}.parquet")

    return str(tmp_path / "in"), str(tmp_path / "out"), come


def by_hand(spark, legs_path):
    legs = [r for r in standins.legs_of(spark.read.parquet(legs_path)).collect() if None not in (r["origin"], r["destination"], r["firstseen"])]
    days = len({r["firstseen"].date() for r in legs})
    n = Counter((r["origin"], r["firstseen"].hour, r["destination"]) for r in legs)
    at = Counter()
    for (o, b, _), k in n.items():
        at[o, b] += k
    return {(o, b, d): (k, at[o, b] / days, k / at[o, b]) for (o, b, d), k in n.items()}


def models(spark, out):
    return {(r["origin"], r["bin"], r["destination"]): (r["n"], pytest.approx(r["rate"]), pytest.approx(r["prob"])) for r in traffic_models.read_models(spark, out).collect()}


def test_models_take_only_what_is_new(spark, growing):
    legs, out, come = growing
    come(0)
    first = traffic_models.run(spark, legs, out, f"{out}/_checkpoint")
    assert first["rows"] == spark.read.parquet(legs).count() and by_hand(spark, legs) == models(spark, out)
    come(1)
    second = traffic_models.run(spark, legs, out, f"{out}/_checkpoint")
    assert first["rows"] + second["rows"] == spark.read.parquet(legs).count() and second["batches"] == 1
    assert by_hand(spark, legs) == models(spark, out)
    files = sorted(glob.glob(f"{out}/models/*/*.parquet"))
    third = traffic_models.run(spark, legs, out, f"{out}/_checkpoint")
    assert third == {"batches": 0, "rows": 0, "origins": 0} and files == sorted(glob.glob(f"{out}/models/*/*.parquet"))


def test_models_after_failures(spark, growing, monkeypatch):
    """A batch that failed after its write, and a run that ended before the models were renewed, are made good by the next run."""
    legs, out, come = growing
    come(0)
    counted = traffic_models.counted

    class Ended(Exception):
        pass

    def fails(*_):
        raise Ended

    monkeypatch.setattr(traffic_models, "renew", fails)
    with pytest.raises(Ended):
        traffic_models.run(spark, legs, out, f"{out}/_checkpoint")
    monkeypatch.undo()
    come(1)

    def half(batch, settings):  # some of the batch's rows were written before it failed
        some = counted(batch, settings)
        some.withColumn("batch", F.lit(1).cast("long")).limit(5).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dep_date", "batch").parquet(f"{out}/counts")
        raise Ended

    monkeypatch.setattr(traffic_models, "counted", half)
    with pytest.raises(Exception, match="Ended"):
        traffic_models.run(spark, legs, out, f"{out}/_checkpoint")
    monkeypatch.undo()
    traffic_models.run(spark, legs, out, f"{out}/_checkpoint")
    assert by_hand(spark, legs) == models(spark, out)


def test_models_are_the_batch_models(spark, tmp_path):
    """Smoothed and mixed shares, a file a batch, as the library's batch operators give them."""
    out = str(tmp_path / "out")
    traffic_models.run(spark, f"{SF}/events.parquet", out, f"{out}/_checkpoint", alpha=0.5, backoff=0.2, files_per_batch=1, minutes=30, zone_hours=2)
    want = model.od_probabilities(standins.legs_of(spark.read.parquet(f"{SF}/events.parquet")), 30, 0.5, 0.2, 2)
    got = {(r["origin"], r["bin"], r["destination"]): r["prob"] for r in traffic_models.read_models(spark, out).collect()}
    assert got == {(r["origin"], r["bin"], r["destination"]): pytest.approx(r["prob"]) for r in want.collect()} and got


def test_models_of_nothing_and_of_odd_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    out = str(tmp_path / "none-out")
    events.limit(0).write.parquet(str(tmp_path / "none"))
    assert traffic_models.run(spark, str(tmp_path / "none"), out, f"{out}/_checkpoint")["rows"] == 0
    assert traffic_models.read_models(spark, out).count() == 0
    odd = events.limit(20).withColumn("props", F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("props"))).withColumn("ts", F.when(F.col("event_id") % 4 != 1, F.col("ts"))).withColumn("n", F.lit(1))
    odd.union(odd).write.parquet(str(tmp_path / "odd"))
    out = str(tmp_path / "odd-out")
    traffic_models.run(spark, str(tmp_path / "odd"), out, f"{out}/_checkpoint")
    assert by_hand(spark, str(tmp_path / "odd")) == models(spark, out) != {}


# --- code mentions ----------------------------------------------------------------------------------------------


def mentions_by_hand(rows, least, as_written=False, include=None):
    texts, times = defaultdict(list), Counter()
    for doc, source, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D,;.:!?()\[\]\"'/|]+", text or "") if re.fullmatch("[A-Z]{4}" if as_written else "[A-Za-z]{4}", w)]
        codes = Counter(w.upper() for w in words)
        for c, n in codes.items():
            if include is None or c in include:
                texts[source, c].append(doc)
                times[source, c] += n
    return {(s, c, len(d), times[s, c], min((x for x in d if x is not None), default=None), len(d) >= least) for (s, c), d in texts.items()}


ROWS = [
    (1, "a", "LOWW to eddf, LOWW! (lszh) naïve xLOWW LOWW1 abcde"),
    (2, "a", "loww/eddf;LFPG|\"KJFK\" 'EGLL'"),
    (3, None, "LOWW"),
    (4, "", "LOWW loww"),
    (None, "b", "EDDF"),
    (5, "b", None),
    (6, "b", ""),
    (7, "a", "EDDF " * 50_000),
    (7, "a", "LOWW"),
    (8, "b=/c %", "EDDF naß éabc"),
]


@pytest.mark.parametrize("settings", [{}, {"as_written": True, "least_texts": 1}, {"include": "LOWW, eddf;zzzz", "files": 1}])
def test_code_mentions(spark, tmp_path, settings):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, source string, text string, code string, n_texts int").repartition(3).write.parquet(texts)
    for _ in range(2):  # a rerun gives the same
        code_mentions.run(spark, texts, out, **settings)
        got = [tuple(r) for r in code_mentions.read_mentions(spark, out).collect()]
        assert len(got) == len(set(got))
        assert set(got) == mentions_by_hand(ROWS, settings.get("least_texts", 3), settings.get("as_written", False), {"LOWW", "EDDF", "ZZZZ"} if "include" in settings else None)


def test_code_mentions_of_nothing(spark, tmp_path):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string").write.parquet(texts)
    assert code_mentions.run(spark, texts, out) == 0 == code_mentions.read_mentions(spark, out).count()


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command lines pass paths and the config file on; the session of the tests stays."""
    for job in (traffic_models, code_mentions):
        monkeypatch.setattr(job, "session", lambda *_: type("S", (), {"stop": lambda self: None, "__getattr__": lambda self, k: getattr(spark, k)})())
    (tmp_path / "c.json").write_text(json.dumps({"least-texts": 1}))
    code_mentions.main(["--texts", f"{SF}/documents.parquet", "--out", str(tmp_path / "o2"), "--config", str(tmp_path / "c.json")])
    assert code_mentions.read_mentions(spark, str(tmp_path / "o2")).filter("not listed").count() == 0
    traffic_models.main(["--legs", f"{SF}/events.parquet", "--out", str(tmp_path / "o1"), "--checkpoint", str(tmp_path / "o1/_c"), "--config", "jobs/traffic_models.json"])
    assert by_hand(spark, f"{SF}/events.parquet") == models(spark, str(tmp_path / "o1"))
