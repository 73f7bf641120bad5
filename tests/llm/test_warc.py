import gzip
import hashlib
import os
import random

import pytest

from twinseek.llm import queries, warc

COLUMNS = "page_id long, url string, html string, key int, shard int, kind int, digest int, size int, record int"


def made():
    random.seed(8)
    prose = ["".join(random.choice("abcdef <>/\r\n") for _ in range(random.randint(0, 900))) for _ in range(60)]
    rows = [(i, f"https://h{i % 3}.example/p/{i}?q=ä b", prose[i % 50]) for i in range(80)]
    hot = "<html>" + "hot " * 60
    rows += [(1000 + i, "https://hot.example/", hot) for i in range(70)]
    rows += [(-5, None, None), (None, "https://n.example/", hot), (None, None, "x" * 100), (None, None, "x" * 100), (7, "u", "y" * 99), (8, "u", "y" * 99)]
    rows += [(500, "a\r\nInjected: 1", "ß" * 50), (501, "b", "ß" * 50), (500, "c", "ß" * 50), (502, "d", "漢\r\n\r\nWARC/1.1\r\n" * 3000)]
    rows += [rows[3], rows[3]]
    return rows


def brute(rows):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    found = []
    groups = {}
    for page, payload in sorted(payloads, key=lambda p: (p[0] is None, p[0] or 0)):
        first = groups.setdefault(payload, []) if len(payload) >= 100 else []
        first.append(page)
        again = len(first) > 1
        found.append(
            (page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[0] if again else None)
        )
    return sorted(found, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], COLUMNS)


def test_query_against_brute_force(spark, tmp_path):
    rows = made()
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.REGISTRY["op13_warc"](spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def archives(folder):
    return {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".gz")}


def test_same_bytes_from_other_partitions(spark, tmp_path):
    rows = made()
    written = []
    for parts, order in ((1, 1), (7, -1)):
        folder = f"{tmp_path}/run{parts}"
        warc.write(table(spark, rows[::order]).repartition(parts), folder, file_bytes=4000, shard_bytes=20_000)
        found = warc.resolved(warc.read(spark, folder))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
        written.append(archives(folder))
    assert written[0] == written[1]
    assert len({f.split("-")[1] for f in written[0]}) > 2 and len(written[0]) > len({f.split("-")[1] for f in written[0]})
    assert all(len(data) < 4000 + 60_000 for data in written[0].values())
    ids = [int(x.split(b"\r\n")[0]) for f in sorted(written[0]) for x in gzip.decompress(written[0][f]).split(b"\r\nPage-Id: ")[1:]]
    assert ids == sorted(ids)


def test_what_the_manifest_does_not_list_is_not_read(spark, tmp_path):
    folder = f"{tmp_path}/archive"
    warc.write(table(spark, made()[:20]), folder)
    extra = next(iter(archives(folder)))
    with open(f"{folder}/shard-00099-00000.warc.gz", "wb") as file:
        file.write(archives(folder)[extra])
    assert warc.read(spark, folder, with_payload=True).filter("payload is not null").count() == 20 == warc.read(spark, folder).count()
    with pytest.raises(FileExistsError):
        warc.write(table(spark, made()[:20]), folder)


def test_damage_is_noticed(spark, tmp_path):
    folder = f"{tmp_path}/archive"
    warc.write(table(spark, made()[:20]), folder)
    name, data = next(iter(archives(folder).items()))
    with open(f"{folder}/{name}", "wb") as file:
        file.write(gzip.compress(gzip.decompress(data).replace(b"h1.example", b"h2.example")))
    with pytest.raises(Exception, match="is not the file that the manifest lists"):
        warc.read(spark, folder).count()


def test_payloads_come_back(spark, tmp_path):
    rows = [r for r in made() if r[0] is not None]
    warc.write(table(spark, rows), f"{tmp_path}/archive", file_bytes=1)
    read = warc.read(spark, f"{tmp_path}/archive", with_payload=True).filter("record_type = 'response'").collect()
    payloads = {(r[0], (r[2] or "").encode()) for r in rows}
    assert {(r["page_id"], bytes(r["payload"])) for r in read} <= payloads
    assert {p for _, p in payloads} == {bytes(r["payload"]) for r in read}


def test_empty_table(spark, tmp_path):
    table(spark, made()[:1]).limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.REGISTRY["op13_warc"](spark, str(tmp_path)).collect() == []
