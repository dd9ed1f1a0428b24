"""Archives, line dedup and mixing against plain Python on small tables."""

import hashlib
import re
from collections import Counter

import pytest
import zstandard

from subsight.llm import line_dedup, mixing, warc

DOCS = "doc_id long, text string, source string, n_chars long, copy_no int, lines_removed string, size int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), 7, "x", 3) for i, t, s in rows], DOCS)


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>" * 500
    pages = [(1, "http://a/x y%20z\n", big), (2, None, big), (3, "http://b", None), (None, "http://c", big), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "v", "q" * 300_000), (7, "v", "q" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    warc.write_warc(warc.plan_records(df).repartition(3), str(tmp_path / "a"))
    rows = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert len(rows) == len(pages) and not any(r.error for r in rows)
    found = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows)
    expected = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = h == big and i != 2
        expected[(i, "revisit" if revisit else "response", 2 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest())] += 1
    assert found == expected
    assert {r.url for r in rows} == {"http://a/x%20y%20z%0A", None, "http://b", "http://c", "u", "v"}
    assert {bytes(r.payload) for r in rows if r.page_id == 2} == {big.encode()}


def test_archive_with_dictionary_and_damage():
    row = {"page_id": 1, "url": "u", "payload": b"body" * 50, "payload_bytes": 200, "digest": hashlib.sha1(b"body" * 50).hexdigest(), "record_type": "response", "refers_to": None}
    records = [warc.record_bytes(row | {"page_id": i}) for i in range(200)]
    learnt = zstandard.train_dictionary(4096, records)
    body = zstandard.ZstdCompressor().compress(learnt.as_bytes())
    frames = [zstandard.ZstdCompressor(dict_data=learnt).compress(r) for r in records]
    lead = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(body)) + body
    whole = lead + b"".join(frames)
    assert [r[2] for r in warc.records_of(whole, "a")] == list(range(200))
    assert [r[-1] for r in warc.records_of(whole[:-3], "a")][-1] == "a frame is cut off"
    broken = records[5].replace(b"Content-Length: 2", b"Content-Length: 9", 1)
    for bad in (broken, records[5].replace(b"bodybody", b"bodyBODY", 1), records[5][:-1], records[5].replace(b"WARC-Type", b"WARC Type")):
        data = lead + frames[0] + zstandard.ZstdCompressor(dict_data=learnt).compress(bad) + frames[1]
        errors = [r[-1] for r in warc.records_of(data, "a")]
        assert errors[0] is None and errors[1] and errors[2] is None


def test_empty_archives(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.through_archives(empty).count() == 0


def test_full_archives_end_and_new_ones_begin(spark, tmp_path):
    # Digests do not compress, so sizes are near those of the frames.
    pages = [(i, f"http://h/{i}", "".join(hashlib.sha256(f"{i}:{k}".encode()).hexdigest() for k in range(i % 7 * 20))) for i in range(600)]
    pages.append((1000, "http://h/large", "".join(hashlib.sha256(f"l{k}".encode()).hexdigest() for k in range(9000))))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = tmp_path / "many"
    warc.write_warc(warc.plan_records(df).coalesce(1), str(path), archive_bytes=100_000)
    files = sorted(path.glob("part-*"))
    assert len(files) > 5
    sizes = sorted(f.stat().st_size for f in files)
    # Only the archive of the large record is larger than its bytes and one record; separators are 8 bytes a row.
    assert sizes[-2] < 100_000 + 40_000 and sizes[-1] < 450_000
    for f in files:
        data = f.read_bytes()
        first = next(warc.frames_of(memoryview(data)))
        assert first[0] in (warc.DICTIONARY_MAGIC, warc.FRAME_MAGIC)
        assert all(r[-1] is None for r in warc.records_of(data, f.name))
    rows = warc.read_warc(spark, str(path)).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in rows) == Counter((i, h.encode()) for i, _, h in pages)
    assert not any(r.error for r in rows)


def test_small_archives_of_every_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * (i * 37 % 500)) for i in range(40)], "page_id long, url string, html string")
    for n in (1, 200, 3000):
        path = str(tmp_path / f"n{n}")
        warc.write_warc(warc.plan_records(pages).repartition(2), path, archive_bytes=n)
        assert sorted(r.page_id for r in warc.read_warc(spark, path).collect()) == list(range(40))


def brute_lines(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out.append((i, None))
            continue
        lines = text.split("\n")
        solid = [p for p, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a in range(len(solid) - 2):
            window = tuple(lines[p].strip(" \t\r") for p in solid[a : a + 3])
            if window in seen:
                gone |= set(solid[a : a + 3])
            seen.add(window)
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    return Counter(out)


def test_line_dedup_against_brute_force(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n b \nc\n\nd\ny"), (3, "a\nb"), (4, ""), (5, None), (6, "k\nk\nk\nk\nk"), (7, "a\nb\nc"), (None, "n\no\np"), (8, "n\no\np\nq"), (9, "\n\n\n"), (10, "\n".join(f"l{i % 700}" for i in range(3000)))]
    found = line_dedup.dedup_lines(docs_of(spark, [(*r, "s") for r in rows])).collect()
    assert Counter((r.doc_id, r.text) for r in found) == brute_lines(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in found) and {r.size for r in found} == {3}
    twice = line_dedup.dedup_lines(docs_of(spark, [(1, "a\nb\nc", "s")] * 2)).collect()
    assert [r.text for r in twice] == ["a\nb\nc"] * 2
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = left / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over
        left -= sum(2 * sizes[s] for s in over)


def test_mix_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), ("b", "a", "é", None, "zz")[i * i % 5]) for i in range(200)] + [(None, "q r", "a"), (None, None, "a"), (201, "", "empty")]
    df = docs_of(spark, rows)
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    planned = mixing.plan_mix(df).collect()
    wanted = brute_targets(sizes)
    assert len(planned) == len(rows)
    for r in planned:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source]
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.taken <= 2 * r.size
    mixed = mixing.mix(df).collect()
    assert len(mixed) == sum(r.copies for r in planned)
    assert set(mixed[0].asDict()) == set(df.columns)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def brute_copies(rows, planned, seed=mixing.SEED):
    """Extra copies go round the size classes; in a class the smallest draws have them."""

    def number(key):
        return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)

    copies, by_source = {}, {}
    for i, t, s in rows:
        by_source.setdefault(s, []).append((len((t or "").split()), number(f"{seed}:{i}"), i))
    rates = {r.source: r.rate for r in planned}
    for source, docs in by_source.items():
        whole, rest = divmod(rates[source], 1)
        passed = number(f"{seed}:source:{source or ''}") / 16**15
        classes = {}
        for size, draw, i in docs:
            bits = max(1, size.bit_length())
            classes.setdefault((bits - 1, (size * 8) >> (bits - 1)) if size else (-1, 0), []).append((draw, i))
        before = 0
        for _, members in sorted(classes.items()):
            wanted = int(passed + (before + len(members)) * rest) - int(passed + before * rest)
            before += len(members)
            for place, (_, i) in enumerate(sorted(members)):
                copies[i] = int(whole) + (place < wanted)
    return copies


def test_extra_copies_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (i * i % 97)), ("a", "b", "c", None)[i % 4]) for i in range(1200)]
    planned = mixing.plan_mix(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.copies for r in planned} == brute_copies(rows, planned)
    for source in ("a", "b", "c", None):
        own = [r for r in planned if r.source == source]
        extra = sum(r.copies - int(r.rate) for r in own)
        assert abs(extra - len(own) * (own[0].rate % 1)) < 1
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.01)


def test_rows_that_share_a_draw_go_together(spark):
    rows = [(None, "same text here", "a")] * 300 + [(5, f"{i} b c", "a") for i in range(50)] + [(i, "x y", "b") for i in range(100, 400)]
    planned = mixing.plan_mix(docs_of(spark, rows)).collect()
    assert len(planned) == len(rows)
    assert len({r.copies for r in planned if r.doc_id is None}) == 1 and len({r.copies for r in planned if r.doc_id == 5}) == 1
    assert all(r.taken <= 2 * r.size for r in planned)
