"""The log engine: token edges, mining shapes, encodings, exact round trips."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings, parser, settings_of
from tessera.functions import numbers
from tessera.functions import tokens as t
from tessera.operators import encode, mine, parse, profile
from tessera.plans import archive
from tessera.sources import lines as src
from tessera.sources import portable

EDGES = [
    "", "   ", "\t", "a\r", "|b||c", "<a> <*> <->", "a<>1 x<><>2", "/", "C:\\", "C:\\x1", "é1/", "٣", "日/本", "007 123456789012345 1234567890123456",
    "k=12345678901234567890123 v:7 v:07 v:abc", "k=12345678901234567890124 v:7", "req abc1 done", "a.b.c.d.e.f.g.h.i.j.k.l.m.n.o.p.q.1", None,
]


def lines_of(spark, texts, chunk=1000):
    rows = [(i // chunk, i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id int, row_no long, line string")


def split_lines():
    return [f"s=a1:w{i % 7}" for i in range(70)] + [f"s={x}:w{i % 5}" for x in ("b2", "c3", "d4") for i in range(10)]


def test_token_classes(spark):
    want = {"abc": "lit", "/": "lit", "007": "num", "123456789012345": "num", "1234567890123456": "str", "abc1": "str", "a-1": "comp", "C:\\x": "comp", "é1": "comp", "٣": "lit", "a<>1": "str"}
    rows = spark.createDataFrame([(k,) for k in want], "tok string").select("tok", t.token_class(F.col("tok")).alias("cls")).collect()
    assert {r.tok: r.cls for r in rows} == want


def test_rows_of_very_long_texts(spark):
    texts = ["x\n" * 100_002 + "end 1", "first 2\nsecond", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    rows = src.column_lines(df, "k", "t", 250)
    assert rows.count() == rows.select("row_no").distinct().count() == 100_006
    assert [r.line for r in rows.where("row_no >= 100000").orderBy("row_no").collect()] == ["x", "x", "end 1", "first 2", "second", ""]
    assert [r.row_no for r in src.column_lines(df.where("k > 0"), "k", "t", 250).orderBy("row_no").collect()] == [100_000, 100_001, 300_000]


def test_tokens_cover_the_line(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a09/<>|()*- \té²٣") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = lines_of(spark, texts).select("line", F.array_join(t.tokens(F.col("line")), "").alias("again")).collect()
    assert all(r.line == r.again for r in rows)


def test_letters(spark):
    rows = spark.range(20000).select("id", numbers.letters_of_id(F.col("id")).alias("s")).withColumn("back", numbers.id_of_letters(F.col("s"))).collect()
    assert all(r.id == r.back and r.s == portable.letters(r.id) for r in rows)
    assert [portable.letters(n) for n in (0, 25, 26, 701, 702)] == ["a", "z", "aa", "zz", "aaa"]


def test_long_words_are_decoded_whole(spark, tmp_path):
    from tessera import queries

    words = {"a": 0, "aa": 26, "purchase": None, "purchased": None, "crpxnlskvljfhh": 2**63 - 1, "crpxnlskvljfhi": -1, "z" * 20: -1}
    for w in ("purchase", "purchased"):
        n = 0
        for c in w:
            n = n * 26 + ord(c) - 96
        words[w] = n - 1
    spark.createDataFrame([(w,) for w in [*words, "Not", ""]], "event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.letters: r.id for r in queries.id_of_letters(spark, str(tmp_path)).collect()}
    assert got == {w: None if n < 0 else n for w, n in words.items()}


def test_leb_sizes_and_bytes(spark):
    values = [0, 1, -1, 63, 64, -64, -65, 127, 128, 8191, 8192, -8192, -8193, 2**40, -(2**40), 2**60]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", numbers.signed_leb_size(F.col("v")).alias("n"), numbers.delta_of_lsb(numbers.lsb_of_delta(F.col("v"))).alias("x")).collect()
    for r in rows:
        data = portable.signed_leb(r.v)
        assert len(data) == r.n and portable.Reader(data).signed() == r.v == r.x
    assert portable.Reader(portable.unsigned_leb(300)).unsigned() == 300


def test_known_matrix_bytes():
    assert portable.read_matrix(bytes([1, 2, 1, 2, 2])) == [[2, 4]]
    assert portable.matrix_bytes([[2, 4]]) == bytes([1, 2, 1, 2, 2])
    with pytest.raises(ValueError):
        portable.read_matrix(bytes([1, 2, 1, 130]))


def test_split_on_representatives(spark):
    d = parse.distinct_composites(parse.variables(lines_of(spark, split_lines())))
    plan = mine.split_plan(profile.slot_values(d)).collect()[0]
    assert (plan.mode, plan.best_slot, plan.split_values) == ("split_reps", 1, ["a1"])
    patterns = {(r.pattern, len(r.vals)) for r in mine.mined(d).collect()}
    assert patterns == {("s=a1:<>", 1), ("s=<>:<>", 2)}


def test_split_on_all_values_and_folding(spark):
    texts = [f"2015-07-{i % 20:02d}" for i in range(60)] + [f"2015-08-{i % 9:02d}" for i in range(30)]
    rules = mine.mined(parse.distinct_composites(parse.variables(lines_of(spark, texts)))).collect()
    assert {r.pattern for r in rules} == {"2015-07-<>", "2015-08-<>"}


def test_many_representatives_are_not_split(spark):
    texts = [f"x{i % 45}:y{i // 3 % 50}" for i in range(300)]
    plan = mine.split_plan(profile.slot_values(parse.distinct_composites(parse.variables(lines_of(spark, texts))))).collect()
    assert [p.mode for p in plan] == ["nosplit"]


def test_delta_choice(spark):
    up = [f"{1000 + i}:{2000 + i}" for i in range(200)]
    lines = lines_of(spark, up + [f"0-0 z{i}" for i in range(3)])
    rules = mine.mined(parse.distinct_composites(parse.variables(lines)))
    inst = encode.instances(mine.pattern_rows(parse.variables(lines), rules))
    joined = encode.joined_numbers(inst, mine.pattern_columns(rules))
    assert [r.eligible for r in encode.delta_eligible(joined).collect()] == [True]
    codes = encode.lsb_deltas(joined)
    back = encode.un_lsb(codes).orderBy("inst_no").collect()
    assert [r.value for r in back] == [int(x.replace(":", "")) for x in up]


@pytest.mark.parametrize("chunk", [7, 1000])
def test_archive_round_trip(spark, tmp_path, chunk):
    rng = random.Random(11)
    wild = ["".join(rng.choice("a09/<>|()*- \té²٣:") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    lines = lines_of(spark, [*EDGES, *split_lines(), *wild], chunk)
    archive.write(lines, str(tmp_path / "a"), Settings())
    back = archive.read(spark, str(tmp_path / "a"))
    assert archive.differences(lines.withColumn("line", F.coalesce("line", F.lit(""))), back).count() == 0
    one = archive.read(spark, str(tmp_path / "a"), [0])
    assert one.count() == lines.where("chunk_id = 0").count()


def test_tables_by_chunk_are_never_broadcast(spark, tmp_path):
    df = lines_of(spark, split_lines() + EDGES, 40)
    archive.write(df, f"{tmp_path}/a")
    v = parse.variables(df)
    rules = mine.mined(parse.distinct_composites(v))
    columns = mine.pattern_columns(rules)
    names = encode.dictionary(v, rules, columns, profile.slot_stats(profile.slot_values(parse.distinct_composites(v))))
    for found in (archive.read(spark, f"{tmp_path}/a"), rules, names, encode.token_codes(rules, columns, names)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty_archive(spark, tmp_path):
    archive.write(lines_of(spark, []), str(tmp_path / "a"))
    assert archive.read(spark, str(tmp_path / "a")).count() == 0


def test_portable_round_trip(spark, tmp_path):
    texts = [*split_lines(), *[f"12:{i:02d} req abc{i} n {i} v:{'07' if i % 2 else 'x1'}" for i in range(40)], "single k=1"]
    made = portable.write_archives(lines_of(spark, texts, 60))
    portable.export(made, str(tmp_path / "out"))
    back = portable.read_archives(portable.load(spark, str(tmp_path / "out"))).orderBy("chunk_id", "line_no").collect()
    assert [r.line for r in back] == texts


def test_text_source_keeps_order_and_returns(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo|2\nlast")
    rows = src.text_lines(spark, str(tmp_path / "a.log"), 2).orderBy("row_no").collect()
    assert [(r.chunk_id, r.row_no, r.line) for r in rows] == [(0, 0, "one\r"), (0, 1, ""), (1, 2, "two|2"), (1, 3, "last")]


def test_settings():
    s = settings_of(parser().parse_args(["-o", "x", "-c", "5", "-z", "2", "-dt", "0.5", "f.log"]))
    assert (s.output, s.chunk_lines, s.split_all_up_to, s.least_dominance) == ("x", 5, 2, 0.5)
    for bad in ({"chunk_lines": 0}, {"least_dominance": 1.0}, {"output": "-x"}, {"threads": -1}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_row_range_and_sampled_differences(spark, tmp_path):
    lines = lines_of(spark, [f"id {i} k={i % 7}:x{i}" for i in range(300)], 50)
    archive.write(lines, str(tmp_path / "a"))
    back = archive.read(spark, str(tmp_path / "a"))
    assert [r.row_no for r in src.row_range(back, 40, 60).orderBy("row_no").collect()] == list(range(40, 60))
    assert src.row_range(back, 5, 5).count() == 0
    assert archive.sampled_differences(lines, back, 50).count() == 0
    other = back.withColumn("line", F.when(F.col("row_no") % 2 == 0, F.col("line")).otherwise(F.concat("line", F.lit("!"))))
    found = archive.sampled_differences(lines, other, 300).collect()
    assert len(found) == 300 and {(r.row_no % 2, r.side) for r in found} == {(1, "before"), (1, "after")}


def test_differences_count_repeats(spark):
    a = spark.createDataFrame([(1, "x")] * 3 + [(2, "y"), (3, None)], "row_no long, line string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "row_no long, line string")
    got = sorted((r.row_no, r.line, r.side) for r in archive.differences(a, b).collect())
    assert got == [(1, "x", "before"), (1, "x", "before"), (2, "y", "before"), (2, "z", "after")]


def test_variables_of_a_line_are_those_of_its_tokens(spark):
    rng = random.Random(8)
    texts = [*[x for x in EDGES if x], *["".join(rng.choice("a09/<>|()*- \té²٣:\\C\xa0\u2028") for _ in range(rng.randint(0, 30))) for _ in range(400)]]
    rows = lines_of(spark, texts).select("line", t.line_variables(F.col("line")).alias("v"), t.line_literals(F.col("line")).alias("l"), t.variables(t.tokens(F.col("line"))).alias("s")).collect()
    for r in rows:
        assert r.v == [x.tok for x in r.s] and len(r.l) == len(r.v) + 1
        assert "".join(a + b for a, b in zip(r.l, [*r.v, ""])) == r.line


def test_archive_uses_and_sizes(spark, tmp_path):
    texts = [*split_lines(), "gone k=9", "n 12 abc1"]
    archive.write(lines_of(spark, texts), str(tmp_path / "a"))
    uses = {r.pattern: r.uses for r in archive.pattern_uses(str(tmp_path / "a"), spark).collect()}
    assert uses == {"s=a1:<>": 70, "s=<>:<>": 30, "k=9": 1}
    got = {r.stream: r["values"] for r in archive.sizes(str(tmp_path / "a"), spark).collect()}
    assert got == {"composites": 70 + 60, "numbers": 1, "strings": 1, "templates": 102}


def test_reports_of_references(spark):
    ids = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "chunk_id int, id long")
    used = spark.createDataFrame([(0, 1), (0, 1), (1, 7)], "chunk_id int, id long")
    got = {(r.chunk_id, r.id): r.state for r in archive.reference_report(ids, used, "id").collect()}
    assert got == {(0, 1): "used", (0, 2): "unused", (1, 1): "unused", (1, 7): "missing"}


def test_missing_templates_read_as_invalid_ids(spark, tmp_path):
    archive.write(lines_of(spark, ["one 1", "two 2", "one 3"]), str(tmp_path / "a"))
    left = spark.read.schema(archive.TABLES["templates"]).parquet(str(tmp_path / "a" / "templates")).where("template_id <> 0")
    left.write.partitionBy("part").parquet(str(tmp_path / "t"))
    shutil.rmtree(tmp_path / "a" / "templates")
    (tmp_path / "t").rename(tmp_path / "a" / "templates")
    assert [r.line for r in archive.read(spark, str(tmp_path / "a")).orderBy("row_no").collect()] == ["<INVALID_ID:0>", "two 2", "<INVALID_ID:0>"]


def test_length_keys(spark):
    rows = spark.range(1, 16).select("id", t.key_of_length(F.col("id")).alias("k")).withColumn("n", t.length_of_key(F.col("k"))).collect()
    assert [r.k for r in rows] == list("abcdefghijklmno") and all(r.n == r.id for r in rows)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tessera import __main__ as cli

    log = "".join(f"req id{i} k={i % 5}:x\r\n" for i in range(120)) + "\nlast"
    (tmp_path / "in.log").write_bytes(log.encode())
    assert cli.main(["-o", str(tmp_path / "a"), "-c", "50", "--legacy", str(tmp_path / "in.log")]) == 0
    assert len(list((tmp_path / "a" / "portable").glob("*.tar.xz"))) == 3
    said = capsys.readouterr().out
    assert all(f"{x}: " in said for x in ("parse", "mining", "dictionary", "patterns", "portable", "total"))
    assert cli.main(["--restore", "-o", str(tmp_path / "b"), str(tmp_path / "a")]) == 0
    back = b"".join(p.read_bytes() for p in sorted((tmp_path / "b").glob("part-*")))
    assert back == log.encode() + b"\n"
    with pytest.raises(SystemExit):
        cli.main(["-c", "0", "x"])


def test_session_keeps_the_master_that_is_named(monkeypatch):
    from tessera import __main__ as cli

    masters = []

    class Builder:
        def appName(self, name):
            return self

        def master(self, name):
            masters.append(name)
            return self

        def getOrCreate(self):
            return None

    class Session:
        builder = Builder()

        @staticmethod
        def getActiveSession():
            return None

    monkeypatch.setattr(cli, "SparkSession", Session)
    monkeypatch.setattr(cli, "SparkConf", lambda: type("C", (), {"contains": lambda self, k: named})())
    monkeypatch.delenv("PYSPARK_GATEWAY_PORT", raising=False)
    for named, env, want in ((False, None, ["local[4]"]), (True, None, []), (False, "1", [])):
        masters.clear()
        monkeypatch.setenv("PYSPARK_GATEWAY_PORT", env) if env else monkeypatch.delenv("PYSPARK_GATEWAY_PORT", raising=False)
        cli.session(Settings())
        assert masters == want


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from tessera.plans import workspace

    class Conf:
        get = staticmethod(lambda *a: None)

    context = type("X", (), {"getConf": lambda self: Conf, "applicationId": "app", "master": "spark://host:7077"})()
    with pytest.raises(ValueError, match="checkpoint"):
        workspace.fresh_path(type("S", (), {"conf": Conf, "sparkContext": context})(), "x")


def test_streaming_chunks(spark, tmp_path):
    from tessera.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(f"req id{i} k={i % 5}:x\n" for i in range(50)))
    query = ingest.archive_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert ingest.read_batches(spark, str(tmp_path / "out")).count() == 50
    (tmp_path / "in" / "b.log").write_text("".join(f"other {i} n={i}/z\n" for i in range(20)))
    query = ingest.archive_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    back = ingest.read_batches(spark, str(tmp_path / "out")).collect()
    assert sorted({r.batch for r in back}) == [0, 1] and {r.line for r in back if r.batch == 1} == {f"other {i} n={i}/z" for i in range(20)}
    assert ingest.read_batches(spark, str(tmp_path / "none")).count() == 0
