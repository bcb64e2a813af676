"""Damaged archives in the form that round_trip writes, and gzip members of many records."""

import gzip
import random

from riskframe.llm import warc


def _html(i):
    return "".join(random.Random(i).choices("abcdefgh <>/", k=3000))


def test_one_damaged_byte_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", _html(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/archives"
    warc.write_archives(pages, path, "gzip")
    for file in (f for f in (tmp_path / "archives").iterdir() if f.name.startswith("part-")):
        data = bytearray(file.read_bytes())
        whole = list(warc.salvage(bytes(data)))
        assert gzip.decompress(bytes(data)).count(b"WARC/1.1\r\n") == len(whole)
        if len(whole) < 3:
            continue
        hit = whole[len(whole) // 2]
        data[(hit["start"] + hit["stop"]) // 2] ^= 0x55
        found = list(warc.salvage(bytes(data)))
        assert [r["page_id"] for r in found if r["kind"] == "record"] == [r["page_id"] for r in whole if r is not hit]
        assert [(r["start"], r["stop"]) for r in found if r["kind"] == "gap"] == [(hit["start"], hit["stop"])]
        file.write_bytes(data)
        (tmp_path / "archives" / f".{file.name}.crc").unlink(missing_ok=True)
        assert warc.gaps(warc.read_archives(spark, path)).count() >= 1
        break
    else:
        raise AssertionError("no archive with three records")


def test_records_before_the_damage_of_a_member_are_kept(spark):
    pages = spark.createDataFrame([(i, "u", _html(i)) for i in range(60)], "page_id long, url string, html string")
    records = [r.value.encode() + b"\r\n\r\n" for r in warc.record_text(warc.plan_records(pages)).collect()]
    data = gzip.compress(b"".join(records)) + gzip.compress(records[0])
    cut = len(data) // 2
    damaged = data[:cut] + bytes(40) + data[cut + 40:]
    for bad, behind in ((damaged, 1), (data[:cut], 0)):
        found = list(warc.salvage(bad))
        good = [r for r in found if r["kind"] == "record"]
        assert 20 < len(good) < 60
        assert [r["inner_start"] for r in good[:len(good) - behind]] == [
            sum(map(len, records[:k])) for k in range(len(good) - behind)]
        assert any(r["kind"] == "gap" for r in found)
