from pyspark.sql import functions as F

from quiltgraph.llm import warc


def files(manifest):
    return sorted((r["name"], r["sha256"], r["records"]) for r in manifest.collect())


def test_same_files_however_rows_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", (1 << 18, 1 << 20))
    # ids in a dense and a sparse part, one id and the null id with many records
    number = F.when(F.col("id") % 5 == 0, F.lit(77)).when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.col("id") * 10**13).otherwise(F.col("id"))
    pages = spark.range(100_000).select(number.cast("long").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("<p>"), F.md5(F.col("id").cast("string").cast("binary")), F.lit("</p>")).alias("html"))
    got = {}
    for k, parts in enumerate((1, 7, 40, 7)):
        folder = f"file://{tmp_path}/w{k}"
        got[k] = files(warc.write_warc(pages.repartition(parts), folder, roll_bytes=1 << 20))
    assert got[0] == got[1] == got[2] == got[3] and sum(r[2] for r in got[0]) == 100_000
    ranges = {r[0].split("-")[1] for r in got[0]}
    assert len(ranges) > 20  # by bytes, so the hot id and the null id are spread
    back = warc.read_warc(spark, f"file://{tmp_path}/w2", with_payload=False)
    assert back.count() == 100_000 and back.where("page_id = 77").count() == 20_000


def test_ranges_of_odd_ids(spark):
    rows = [(-(2**63), 10), (2**63 - 1, 10), (0, 10), (5, 10**9), (6, 10)]
    found = warc.even_ranges(spark.createDataFrame(rows, "page_id long, n long"))
    assert found.starts == sorted(found.starts) and max(found.spread) > 1 and found.nulls == 0
    df = spark.createDataFrame([(i, str(k)) for i in (-(2**63), -5, 0, 5, 6, 2**63 - 1) for k in range(50)], "page_id long, url string")
    of = {}
    for r in df.select("page_id", found.column(F.col("page_id"), F.col("url")).alias("r")).collect():
        of.setdefault(r["page_id"], set()).add(r["r"])
    assert len(of[5]) > 1 and max(of[0]) <= min(of[5]) and max(of[5]) <= min(of[6]) and all(len(v) == 1 for i, v in of.items() if i != 5)
    none = warc.even_ranges(spark.createDataFrame([(None, 100)], "page_id long, n long"))
    assert none.nulls == 1
