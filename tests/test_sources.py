"""Files in and out, and scoring of streams."""

from pyspark.sql import functions as F

from assayline.operators.encode import category_codes, dummy_variables
from assayline.operators.outliers import hampel_limits
from assayline.operators.scale import fit_scaler
from assayline.operators.signal import smooth_spectra, smooth_spectra_wide, wavelength_table
from assayline.sources import tables as A
from assayline.streaming.frozen import flag_stream, scale_stream


def test_samples_with_unnamed_id(spark, tmp_path):
    path = tmp_path / "samples.csv"
    path.write_text(",x,y z,word\nsample_1,1.5,,a\nsample_2,,2,b\nsample_3,NaN,3,\n")
    rows = A.read_samples(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("sample_1", 1.5, None, "a"), ("sample_2", None, 2, "b"), ("sample_3", None, 3, None)]
    typed = A.read_samples(spark, str(path), "key", "key string, x double, v double, word string")
    assert typed.columns == ["key", "x", "v", "word"] and typed.count() == 3


def test_headerless_files(spark, tmp_path):
    (tmp_path / "x.data").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "y.csv").write_text("0,1\n1,0\n")
    assert [tuple(r) for r in A.read_delimited(spark, str(tmp_path / "x.data"), " ", [0, 2]).orderBy("0").collect()] == [(1, 3), (4, 6)]
    labels = A.read_labels(spark, str(tmp_path / "y.csv"))
    assert labels.columns == ["id", "label"] and labels.count() == 2
    features = A.read_delimited(spark, str(tmp_path / "x.data"), " ", prefix="c").withColumn("id", F.expr("int(c0 / 4)"))
    assert A.attach_labels(features, labels, "id").count() == 2


def test_results_by_hyperparameter(spark, tmp_path):
    rows = spark.range(6).select("id", (F.col("id") % 2 == 0).alias("flag"), F.pmod("id", F.lit(3)).alias("components"))
    A.write_result(rows, str(tmp_path / "out"), ["components"])
    assert sorted(p.name for p in (tmp_path / "out").glob("components=*")) == [f"components={i}" for i in range(3)]
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*/*.csv"))
    assert "true" in text and '"' not in text
    A.write_result(rows, str(tmp_path / "table"), kind="parquet")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6
    table = A.hyperparameter_table(spark, {"C": 7.6, "gamma": -13.2})
    assert [tuple(r) for r in table.collect()] == [("C", 8.0), ("gamma", -13.0)]


def test_dummies_and_codes_with_missing_values(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, None, 3.0), (3, "a", 4.0), (4, "b", 5.0)], "id int, kind string, v double")
    wide = dummy_variables(df, "id").orderBy("id")
    assert wide.columns == ["id", "v", "kind_a", "kind_b"]
    assert [tuple(r)[2:] for r in wide.collect()] == [(False, True), (False, False), (True, False), (False, True)]
    codes = [r["code"] for r in category_codes(df, "kind", ["id"]).orderBy("id").collect()]
    assert codes == [0, None, 1, 0]


def test_wide_spectra(spark):
    names = [str(800 + 2.5 * i) for i in range(25)]
    row = [float(i * i % 7) for i in range(25)]
    df = spark.createDataFrame([(1, *row)], "id int, " + ", ".join(f"`{n}` double" for n in names))
    wide = smooth_spectra_wide(df, names, 9, 2, 1).first()
    array = smooth_spectra(spark.createDataFrame([(row,)], "x array<double>"), "x", 9, 2, 1).first()["x"]
    assert list(wide)[1:] == array
    assert [r["wavelength"] for r in wavelength_table(df, names).orderBy("position").collect()] == [float(n) for n in names]


def test_streams_equal_tables(spark, folder, tmp_path):
    events = A.read_table(spark, folder, "events").select("event_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    limits, scaler = hampel_limits(events, "value", ["event_type"]), fit_scaler(events, ["value"])
    for name, live, table in (
        ("flags", flag_stream(stream, "value", limits, ["event_type"]), flag_stream(events, "value", limits, ["event_type"])),
        ("scaled", scale_stream(stream, scaler), scaler.autoscale(events)),
    ):
        run = live.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination(120)
        columns = sorted(table.columns)
        assert spark.table(name).select(columns).exceptAll(table.select(columns)).isEmpty()
        assert spark.table(name).count() == table.count()
