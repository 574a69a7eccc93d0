import zlib
from collections import Counter

from evigraph.llm import sharding


def expected(rows, shards):
    """The same law, one row after the other."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    total, end, out, slots = sum(r[1] for r in rows), 0, [], Counter()
    for doc_id, size, crc in rows:
        end += size
        shard = (2 * end - size) * shards // (2 * total)
        out.append((doc_id, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


def measured(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    return [(i, len(b) + 8, zlib.crc32(b)) for i, b in raw]


def got(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=str)


def test_brute_force(documents, texts):
    df = sharding.assign(documents, 24, rows_per_block=37)
    assert got(df) == expected(measured(texts.items()), 24)
    assert {r.law for r in df.collect()} == {"bytes"}


def test_balance(documents):
    rows = sharding.assign(documents, 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    target = sum(sizes.values()) / 8
    assert all(abs(x - target) <= max(r.size for r in rows) for x in sizes.values())


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(sharding.assign(odd, 3, rows_per_block=2)) == expected(measured(rows), 3)
    assert sharding.assign(none).count() == 0


def test_files(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(documents, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == documents.count()
    assert back.select("_shard").distinct().count() == 4
