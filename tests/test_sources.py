from pyspark.sql import functions as F

from kohorta.sources.readers import blank_edges, read_lines, scan_catalog, scan_fixed_width, scan_ragged_csv
from kohorta.sources.sinks import sink_csv, stage


def test_fixed_width_accents_blank_head_and_many_files(spark, tmp_path):
    head = "Auszug\n\nICD   Nr\n"
    for i, (name, number) in enumerate((("Müller", "7"), ("Ä", "12345"), ("", "99"))):
        line = f"G70.{i} {name:<8} {number:>6} Zoë {i}\n"
        (tmp_path / f"part{i}.txt").write_bytes((head + line * 2).encode("ISO-8859-1"))
    got = scan_fixed_width(spark, str(tmp_path), ["icd", "name", "nr", "first"], 3, "ISO-8859-1",
                           spec=[(1, 5), (7, 8), (16, 6), (23, 9)])
    rows = sorted(tuple(r) for r in got.distinct().collect())
    assert rows == [("G70.0", "Müller", "7", "Zoë 0"), ("G70.1", "Ä", "12345", "Zoë 1"), ("G70.2", None, "99", "Zoë 2")]
    assert got.count() == 6


def test_edges_come_from_positions_blank_in_all_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head over all\nab  12 q\na   1\nccc 23 9\n")
    lines = read_lines(spark, str(tmp_path / "a.txt"), skip=1)
    assert blank_edges(lines) == [(1, 3), (5, 2), (8, 1)]
    assert [r.line_no for r in lines.orderBy("block_start", "line_no").collect()] == [1, 2, 3]


def test_file_blocks_keep_order_and_drop_the_head_once(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("head,x\n" + "".join(f"p,{i},v{i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, str(path), skip=1)
        assert lines.select("block_start").distinct().count() > 5
        ordered = [r.line for r in lines.orderBy("block_start", "line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered == [f"p,{i},v{i}" for i in range(4000)]


def test_ragged_cells_are_filled_to_the_widest_line(spark, tmp_path):
    (tmp_path / "p1.csv").write_text("h\np1,e1,a,b,c\np1,e1,d\n")
    (tmp_path / "p2.csv").write_text("h\np2,e2,x\n")
    cells = scan_ragged_csv(spark, str(tmp_path), keys=["patient", "encounter"])
    got = [(r.patient, r.value) for r in cells.orderBy("patient", "col_pos", "row_pos").collect()]
    assert got == [("p1", "a"), ("p1", "d"), ("p1", "b"), ("p1", None), ("p1", "c"), ("p1", None), ("p2", "x")]


def test_quoted_cells_and_other_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\nK_1,E,"0,42",mmol,,"x ""y"" z"\n,,"",q"r\n' + 'K,E,"' + 'v,' * 40_000 + '"\n')
    got = {}
    for r in scan_ragged_csv(spark, str(tmp_path / "a.csv"), keys=["p", "e"], fill=False).collect():
        got.setdefault(r.p, {})[r.col_pos] = r.value
    assert got["K_1"] == {0: "0,42", 1: "mmol", 2: "", 3: 'x "y" z'} and got[""] == {0: "", 1: 'q"r'}
    assert got["K"] == {0: "v," * 40_000}
    for sep in ("|", ";", "::"):
        path = tmp_path / f"b{ord(sep[0])}.csv"
        path.write_text(f"h\np{sep}e{sep}a{sep}\"b{sep}c\"{sep}\n")
        cells = scan_ragged_csv(spark, str(path), keys=["p", "e"], sep=sep).collect()
        assert [r.value for r in sorted(cells, key=lambda r: r.col_pos)] == ["a", f"b{sep}c", ""]


def test_catalog_drops_empty_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "full.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "empty.parquet"))
    assert list(scan_catalog(spark, str(tmp_path))) == ["full"]


def test_stage_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    for _ in range(2):
        assert stage(spark, str(tmp_path / "s"), build).count() == 5
    assert calls == [1]
    sink_csv(spark.range(2).withColumn("n", F.lit("ü")), str(tmp_path / "csv"), "ISO-8859-1")
    back = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(str(tmp_path / "csv"))
    assert {r.n for r in back.collect()} == {"ü"}
