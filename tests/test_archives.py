"""Gzip archives that are whole, cut, damaged, joined or empty."""

import gzip
import io
import json
import random

import pytest

from tallyrank.sources import archives


def packed(rows):
    return gzip.compress("".join(json.dumps(r) + "\n" for r in rows).encode())


def test_whole_lines_before_the_break(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"user": i, "text": f"text {rng.random()}"} for i in range(20_000)]
    data = packed(rows)
    files = {"whole": data, "cut": data[: len(data) * 2 // 3], "damaged": data[: len(data) // 2] + b"\xff" * 2000 + data[len(data) // 2 + 2000 :], "joined": packed(rows[:50]) + packed(rows[50:90]), "empty": gzip.compress(b""), "nothing": b"", "noend": gzip.compress(b'{"user": 1}\n{"user": 2}')}
    for name, content in files.items():
        (tmp_path / f"{name}.json.gz").write_bytes(content)
    found, report = archives.partial_json_lines(spark, "user long, text string", f"{tmp_path}/*.json.gz")
    told = {r["file"].rpartition("/")[2].partition(".")[0]: r for r in report.collect()}
    assert set(told) == set(files)
    assert told["whole"]["kept"] == 20_000 and told["whole"]["error"] is None and told["whole"]["lost_bytes"] == 0
    assert told["joined"]["kept"] == 90 and told["empty"]["kept"] == 0 == told["nothing"]["kept"] and told["noend"]["kept"] == 2
    assert all(told[x]["error"] is None for x in ("joined", "empty", "nothing", "noend"))
    assert 10_000 < told["cut"]["kept"] < 14_500 and told["cut"]["error"] and told["damaged"]["error"] and told["damaged"]["kept"] > 9_000  # with what the damage made of some
    by_file = {n: [json.loads(r["line"])["user"] for r in archives.archive_lines(spark, f"{tmp_path}/{n}.json.gz").where("not ended").orderBy("line_no").collect()] for n in ("cut", "joined")}
    assert by_file["cut"] == list(range(told["cut"]["kept"])) and by_file["joined"] == list(range(90))
    assert found.count() >= sum(r["kept"] for n, r in told.items() if n != "damaged")
    with pytest.raises(FileNotFoundError):
        archives.archive_lines(spark, f"{tmp_path}/none*.gz")


def test_what_a_cut_loses():
    data = gzip.compress(b"".join(b"%d " % i + b"x" * (i % 90) + b"\n" for i in range(5000)))
    for cut in range(1, len(data), len(data) // 40):
        *kept, last = archives.lines(io.BytesIO(data[:cut]), "f")
        assert last[3] and last[4] == len(kept) and last[6] and [r[2].split(" ")[0] for r in kept] == [str(i) for i in range(len(kept))]
