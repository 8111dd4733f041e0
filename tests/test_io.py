import pytest

from spindlewatch.sources import readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_hdd_days_with_different_headers(spark, tmp_path):
    write(tmp_path / "2024-01-01.csv", "date,model,serial_number,failure,smart_5_raw\n2024-01-01,A,s1,0,3\n2024-01-01,B,s2,0,x\n")
    write(tmp_path / "2024-01-02.csv", "date,serial_number,model,failure,smart_9_raw,smart_5_raw\n2024-01-02,s1,A,1,7,4\n")
    df = readers.read_smart_daily(spark, str(tmp_path), "2024-01-01", 2, models=["A"])
    got = {(r.disk, str(r.day), r.failure, r.smart_5_raw, r.smart_9_raw) for r in df.collect()}
    assert got == {("s1", "2024-01-01", 0, 3.0, None), ("s1", "2024-01-02", 1, 4.0, 7.0)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_smart_daily(spark, str(tmp_path), "2024-01-02", 2).collect()


def test_ssd_days(spark, tmp_path):
    write(tmp_path / "20240101.csv", "ds,model,disk_id,n_5,r_5\n20240101,MC1,1,100,0\n20240101,MC1,2,\\N,0\n")
    write(tmp_path / "20240102.csv", "ds,model,disk_id,n_5,r_5\n20240102,MC1,1,99,1\n")
    write(tmp_path / "fail" / "f.csv", "disk_id,model,failure_time\n1,MC1,2024-01-01 11:00:00\n")
    failures = readers.read_failures(spark, str(tmp_path / "fail"))
    df = readers.read_ssd_daily(spark, str(tmp_path), "2024-01-01", 2, failures)
    got = [(r.disk, str(r.day), r.smart_5_normalized, r.smart_5_raw, r.failure) for r in df.collect()]
    assert got == [("s1", "2024-01-01", 100.0, 0.0, 1)]


def test_cache_list_and_columns(spark, tmp_path):
    write(tmp_path / "a.json", '{"disk_id":"d","window_end_time":"2024-01-01","z_llm":[1.0,null],"confidence":0.5}\n')
    write(tmp_path / "b.json", '{"disk_id":"d","window_end_time":"2024-01-01","z_llm_0":1.0,"z_llm_1":null,"llm_rule_match":true}\n')
    for name in ("a", "b"):
        assert readers.read_cache(spark, str(tmp_path / f"{name}.json"), 3).first().z == [1.0, 0.0, 0.0]


def test_trace_and_eval(spark, tmp_path):
    write(tmp_path / "t.csv", "eval_day,source_day,serial_number,true_class,pred_class,vote_0,vote_1,queue_size,threshold\n2024-01-05,,s,1,x,0.1,0.9,3,0.5\n")
    r = readers.read_trace(spark, str(tmp_path / "t.csv")).first()
    assert (str(r.source_day), r.true_class, r.pred_class) == ("2024-01-05", 1, 0)
    write(tmp_path / "e.csv", "date,l_Recall_c1\n2024-01-05,50\n,1\n")
    assert readers.read_eval_csv(spark, str(tmp_path / "e.csv")).count() == 1


def test_points_and_ratings(spark, tmp_path):
    write(tmp_path / "p.csv", "0.5,1.5,2\n")
    assert readers.read_points(spark, str(tmp_path / "p.csv"), 2, True).first()[:] == (0.5, 1.5, 2)
    write(tmp_path / "r.tsv", "1\t2\t3.5\t999\n")
    assert readers.read_ratings(spark, str(tmp_path / "r.tsv")).first()[:] == (1, 2, 3.5)


def test_checked_append(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    writers.write_rows(df, path, "parquet")
    writers.append_checked(df, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="columns differ"):
        writers.append_checked(df.withColumnRenamed("v", "w"), path)


def test_log_crosses_2020(spark, tmp_path):
    from spindlewatch.sources import readers

    days = ["2019-12-30", "2019-12-31", "2020-01-01", "2020-01-02", "2021-01-01"]
    block = "{}\nGlobal Measurements\n20 lines follow\n  x = 1\nLocal Measurements\n  y = 2\n"
    (tmp_path / "log.txt").write_text("".join(block.format(d) for d in days))
    assert sorted(str(r.date) for r in readers.read_evaluation_log(spark, str(tmp_path)).collect()) == days


def test_day_in_two_batches(spark, tmp_path):
    from spindlewatch.streaming import jobs

    rows = spark.createDataFrame([("a", "m", "2024-01-01", 0, 1.0), ("b", "m", "2024-01-01", 0, 2.0)], "disk string, model string, day string, failure int, x double")
    rows = rows.withColumn("day", rows.day.cast("date")).withColumn("failure", rows.failure.cast("long"))
    for i, disk in enumerate("ab"):
        rows.where(f"disk = '{disk}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest_days(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
