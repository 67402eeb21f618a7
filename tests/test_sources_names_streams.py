"""Files, name steps and streams on fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallywick.functions import names
from tallywick.operators import community, extract, ranking, resolve
from tallywick.sources import files
from tallywick.streaming import events as streams


def test_csv(spark, tmp_path):
    body = 'h1,h2\r\nh3,h4\r\n"山""x","two\nlines"\r\nb,\r\n'
    (tmp_path / "a.csv").write_bytes(body.encode("shift_jis"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    got = files.read_csv(spark, str(tmp_path / "a.csv"), schema, "Shift_JIS", skip=2).collect()
    assert [tuple(r) for r in got] == [('山"x', "two\nlines"), ("b", None)]


def test_dictionary_duplicates(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n  "a": "1",\n  "b": "2",\n  "a": "3"\n}\n')
    rows, twice = files.read_dictionary(spark, str(tmp_path / "d.json"))
    assert rows.count() == 3 and [tuple(r) for r in twice.collect()] == [("a", 2)]


def test_decoding(spark):
    rows = [(1, "校歌".encode("shift_jis"), "text/html; charset=Shift_JIS"), (2, '<meta charset="euc-jp">山'.encode("euc-jp"), None), (3, "é".encode(), None), (4, b"x", "charset=klingon")]
    got = {r.k: (r.text, r.charset_known) for r in files.decode_pages(spark.createDataFrame(rows, "k int, b binary, h string"), "b", "h").collect()}
    assert got == {1: ("校歌", True), 2: ('<meta charset="euc-jp">山', True), 3: ("é", True), 4: ("x", False)}


def test_partitions_without_rows_survive(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p", ["v"])
    files.write_partitions(spark.createDataFrame([(9, "a")], "v int, p string"), path, "p", ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "b"), (9, "a")]
    assert files.read_partition(spark, path, "p", "zzz").count() == 0
    assert "PartitionFilters: [isnotnull(p" in files.read_partition(spark, path, "p", "a")._jdf.queryExecution().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    lit = F.lit
    assert one(spark, names.fold_width(lit("Ａ１ー２－３ "))) == "Ａ1-2-3"
    assert one(spark, names.name_key(lit("神埼 ケ（香川）"))) == "神崎ヶ"
    assert one(spark, names.is_combined(lit("東･西"))) and one(spark, names.is_combined(lit("大東 小西"))) and not one(spark, names.is_combined(lit("大 東")))
    assert one(spark, names.pick_round(lit("準々決勝"))) == "quarter" and one(spark, names.pick_round(lit("二回戦"))) == "round 2" and one(spark, names.pick_round(lit("他"))) is None
    assert one(spark, names.pick_venue(lit("■県営球場 他"))) == "県営球場"
    assert one(spark, names.label_candidates(lit("熊本工業高校"))) == ["熊本工業高校", "熊本工業", "熊本工"]
    assert one(spark, names.district_candidates(lit("熊本北星"), lit("熊本"))) == ["北星"] and one(spark, names.district_candidates(lit("熊本"), lit("熊本"))) == []
    assert one(spark, names.establishment(lit("東京都立日比谷高等学校"), lit("2"), lit("東京都"))) == "prefectural" and one(spark, names.establishment_label(lit("prefectural"), lit("大阪"))) == "府立"
    assert one(spark, names.establishment(lit("宮城県仙台第一高等学校"), lit("2"), lit("宮城県"))) == "prefectural" and one(spark, names.establishment(lit("宮城県仙台市立仙台高等学校"), lit("2"), lit("宮城県"))) == "municipal"
    assert one(spark, names.establishment(lit("私学"), lit("3"), lit("宮城県"))) is None and one(spark, names.establishment_label(lit("prefectural"), lit("西東京"))) == "都立"
    assert one(spark, names.municipality(lit("三重県四日市市富田"))) == "四日市市" and one(spark, names.municipality(lit("大阪府大阪市北区"))) == "大阪市"
    assert one(spark, names.split_name(lit("長野県立上田高等学校"), lit("長野県"))).display == "上田高校"
    assert tuple(one(spark, names.split_name(lit("新潟県立新潟県央工業高等学校"), lit("新潟県")))) == ("新潟県央工業", "新潟県央工業高校")
    assert tuple(one(spark, names.split_name(lit("熊本県立第一高等学校"), lit("熊本県")))) == ("熊本県立第一", "熊本県立第一高校")
    assert one(spark, names.municipality(lit("群馬県佐波郡玉村町上新田"))) == "玉村町" and one(spark, names.municipality(lit("長野県北安曇郡大町町"))) == "大町町"
    halves = {c: one(spark, names.capital_half(lit(c))) for c in ("港区", "練馬区", "三宅村", "町田市", "")}
    assert halves == {"港区": "higashi-tokyo", "練馬区": "nishi-tokyo", "三宅村": "higashi-tokyo", "町田市": "nishi-tokyo", "": None}
    cities = spark.createDataFrame([("札幌市",), ("旭川市",), ("他",)], "city string")
    offices = spark.createDataFrame([("札幌市", "石狩"), ("旭川市", "上川")], "city string, office string")
    assert {r.city: r.half for r in names.north_south(cities, "city", offices).collect()} == {"札幌市": "minami-hokkaido", "旭川市": "kita-hokkaido", "他": None}
    assert one(spark, names.yearless_date(lit("8月12日"), lit(2024))) == dt.date(2024, 8, 12) and one(spark, names.yearless_date(lit("2月30日"), lit(2024))) is None
    assert one(spark, names.japanese_date(lit(dt.date(2024, 8, 2)))) == "8月2日"
    assert one(spark, names.era_year(lit("令和元年"))) == 2019 and one(spark, names.era_year(lit("第100回"))) == 2018
    assert one(spark, names.valid_visitor(lit("a" * 16))) and not one(spark, names.valid_visitor(lit("a" * 65)))
    assert one(spark, names.linescore(F.array(lit("0"), lit("2x")), F.array(lit("1"), lit("X"), lit("0")))).innings == 3
    assert one(spark, names.inning_runs(lit("2x"))) == 2 and one(spark, names.inning_runs(lit("X"))) is None
    assert one(spark, names.likely_photo(lit("School.JPG"))) and not one(spark, names.likely_photo(lit("logo.png")))
    assert one(spark, names.short_name(lit("上田高校"), lit(None).cast("string"))) == "上田"


def test_orientation(spark):
    sides = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("public"), F.lit(w).alias("won")) for n, p, w in (("a", False, True), ("b", True, False))))
    assert [s.n for s in one(spark, names.orient(sides))] == ["b", "a"]


def test_aliases_never_override(spark):
    labels = spark.createDataFrame([("s", "x", 1)], "scope string, label string, t int")
    aliases = spark.createDataFrame([("s", "x", 2), ("s", "y", 2), ("s", "z", 77)], "scope string, label string, t int")
    out, dangling = resolve.add_aliases(labels, aliases, spark.createDataFrame([(1,), (2,)], "t int"), "scope", "label", "t")
    assert sorted(map(tuple, out.collect())) == [("s", "x", 1), ("s", "y", 2)] and dangling.count() == 1


SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def run(stream, spark, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def landed(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp")).filter("user_id is not null")
    e.coalesce(1).write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events"))


def test_streams_match_their_batch_twins(spark, tmp_path):
    e = landed(spark, tmp_path)
    s = streams.with_event_time(streams.read_events(spark, str(tmp_path / "events"), e.schema), "ts", "1 hour")
    presses = run(streams.unique_presses(s, ["user_id", "event_type"]), spark, "presses", tmp_path)
    assert presses.count() == e.select("user_id", "event_type").distinct().count()
    ok = e.select("user_id").distinct().filter("user_id % 2 = 0")
    assert run(streams.guard_target(s, ok, "user_id"), spark, "guarded", tmp_path).count() == e.filter("user_id % 2 = 0").count()


T0 = dt.datetime(2024, 1, 1)


def runs(spark, tmp_path, make, batches, mode):
    """Rows that a stream emits over batches of (key, minute, id, value), one run each from the same checkpoint."""
    schema, got = "k string, ts timestamp, id int, v string", []
    for rows in batches:
        rows = [(k, T0 + dt.timedelta(minutes=m), i, v) for k, m, i, v in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = make(streams.with_event_time(streams.read_events(spark, str(tmp_path / "in"), schema), "ts", "10 minutes"))
        q = s.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return got


def test_stream_counter_takes_batches_in_order_of_time(spark, tmp_path):
    """Changes that arrive out of order, in another batch than their neighbours, and too late."""
    batches = [
        [("a", 3, 3, "-1"), ("a", 1, 1, "-1"), ("a", 2, 2, "1"), ("b", 0, 0, "1")],
        [("a", 40, 7, "-1"), ("a", 30, 5, "1"), ("a", 38, 6, "1"), ("a", 30, 4, "-1")],
        [("a", 35, 8, "1"), ("a", 1, 9, "1"), ("tick", 999, 10, "1")],
    ]
    got = runs(spark, tmp_path, lambda s: streams.saturating_counts(s, "k", F.col("v").cast("int"), "ts", "id"), batches, "update")
    # minute 35 comes within the delay and counts before 38; minute 1 of the last batch is too late
    assert [n for k, n in got if k == "a"][-1] == 2 and [n for k, n in got if k == "b"] == [1]


def test_stream_publication_is_stamped_once(spark, tmp_path):
    batches = [
        [("a", 1, 1, "draft"), ("b", 1, 1, "published"), ("c", 2, 1, None)],
        [("a", 21, 3, "published"), ("b", 22, 2, "draft"), ("c", 23, 2, "published")],
        [("a", 41, 4, "draft"), ("b", 42, 3, "published"), ("a", 43, 5, "published"), ("b", 44, 4, "published")],
        [("tick", 999, 9, "draft")],
    ]
    got = runs(spark, tmp_path, lambda s: streams.first_published(s, "k", "v", "ts", "id"), batches, "append")
    assert sorted(got) == [("a", T0 + dt.timedelta(minutes=21)), ("b", T0 + dt.timedelta(minutes=42))]


def test_stream_rate_limit_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), m + rng.randint(0, 5), m, "x") for m in range(120)]
    batches = [rows[i : i + 40] for i in range(0, 120, 40)] + [[("tick", 9999, 999, "x")]]
    got = runs(spark, tmp_path, lambda s: streams.rate_limit(s, "k", "ts", "id", 2, 600), batches, "append")
    frame = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), i) for k, m, i, _ in rows], "k string, ts timestamp, id int")
    want = {r.id: r.accepted for r in community.rate_limit(frame, "k", "ts", "id", 2, 600).collect()}
    assert {r[0]: r[3] for r in got} == want and len(got) == 120


def test_rate_limit_spreads_one_visitor(spark):
    """Segments between gaps are dealt on their own, and the verdicts are those of one pass."""
    rng = random.Random(4)
    minute, rows = 0, []
    for i in range(400):
        minute += rng.choice([0, 1, 2, 3, 10, 11, 60])
        rows.append(("v", T0 + dt.timedelta(minutes=minute), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    parts = community.gap_segments(df, "k", "ts", 600).groupBy("segment").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert len(parts) > 50 and all((y.a - x.b).total_seconds() >= 600 for x, y in zip(parts, parts[1:], strict=False))
    accepted, want = [], {}
    for _, t, i in rows:
        accepted = [x for x in accepted if (t - x).total_seconds() < 600]
        want[i] = len(accepted) < 2
        accepted += [t] if want[i] else []
    limited = community.rate_limit(df, "k", "ts", "id", 2, 600)
    assert {r.id: r.accepted for r in limited.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert limited.groupBy(F.spark_partition_id().alias("p")).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_merge_into_partitions(spark, tmp_path):
    """Two batches into one partition keep both; a batch taken again or without news rewrites nothing."""
    path, log, schema = str(tmp_path / "out"), str(tmp_path / "log"), "id int, v string, k string"
    spark.createDataFrame([(1, "old", "x"), (2, "stays", "y")], schema).write.partitionBy("k").parquet(path)
    batches = [[(1, "new", "x"), (3, "a", "z")], [(4, "b", "x"), (3, "a", "z"), (5, None, "z"), (5, None, "z")], [(1, "new", "x"), (4, "b", "x")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = streams.read_events(spark, str(tmp_path / "in"), schema)
        streams.write_changed_partitions(s, path, str(tmp_path / "cp"), "k", ["id"], log=log).awaitTermination(120)
    got = sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()))
    assert got == [(1, "new", "x"), (2, "stays", "y"), (3, "a", "z"), (4, "b", "x"), (5, None, "z")]
    written = spark.read.schema("k string, digest string, batch int").parquet(f"{log}/*").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in written} == {"x": 2, "z": 2}


def test_landed_pages(spark, tmp_path):
    path = str(tmp_path / "bodies")
    rows = [("u1", b"a"), ("u2", b""), (None, b"n"), ("u3", None)]
    files.land_pages(spark.createDataFrame(rows, "url string, content binary").repartition(2), path)
    files.land_pages(spark.createDataFrame([("u1", b"newer", 404, T0)], "url string, content binary, status int, fetched_at timestamp"), path)
    got = {r.url: (bytes(r.content) if r.content is not None else None, r.status, r.intact) for r in files.read_landed(spark, path).collect()}
    assert got == {"u1": (b"newer", 404, True), "u2": (b"", None, True), None: (b"n", None, True), "u3": (None, None, False)}
    broken = spark.read.parquet(path).withColumn("content", F.lit(b"x"))
    broken.write.parquet(str(tmp_path / "broken"))
    assert not any(r.intact for r in files.read_landed(spark, str(tmp_path / "broken")).collect())


def test_fragments_of_one_page_in_many_segments(spark):
    rng = random.Random(5)
    ys = [round(rng.uniform(0, 60), 1) for _ in range(80)] + [round(100.0 + 20 * i + rng.choice([0, 0.5, 3.0, 3.1, 6.2]), 1) for i in range(150)]
    rows = [("p", y, i) for i, y in enumerate(ys)] + [("p", None, 900), (None, 1.0, 901), (None, 5.0, 902), ("q", 7.0, 903)]
    want, anchor, line = {900: None, 901: 1, 902: 0, 903: 0}, None, -1
    for y, i in sorted(((y, i) for i, y in enumerate(ys)), key=lambda x: -x[0]):
        if anchor is None or anchor - y > 3.0:
            anchor, line = y, line + 1
        want[i] = line
    df = spark.createDataFrame(rows, "page string, y double, id int")
    assert {r.id: r.line for r in extract.anchored_rows(df, ["page"], "y", 3.0).collect()} == want


def test_quantile_bands_equal_the_sorted_places(spark):
    rng = random.Random(6)
    for values in ([rng.choice([-1, 0, 5, 5, 9]) for _ in range(50)], [rng.randint(-20, 3000) for _ in range(2000)], [7] * 500 + list(range(1, 40)), []):
        positive = sorted(v for v in values if v > 0)
        kinds = sorted(set(positive))
        cuts = kinds if len(kinds) <= 5 else sorted({positive[len(positive) * i // 5] for i in range(5)})
        df = spark.createDataFrame(list(enumerate(values)), "id int, n int")
        got = {r.id: r.band for r in ranking.quantile_bands(df, "n", 5).collect()}
        assert got == {i: sum(c <= v for c in cuts) if v > 0 else 0 for i, v in enumerate(values)}


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(i, "large" if i % 10 else None) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_partitions(spark.createDataFrame(rows, "id int, k string"), path, "k", ["id"], file_rows=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.schema("id int, k string").parquet(path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    of = [r.k for r in back.select(F.input_file_name().alias("f"), "k").distinct().collect()]
    assert of.count("large") > 1 and of.count(None) == 1
