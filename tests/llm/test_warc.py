"""Archives written, deduplicated and read back, against the pages themselves."""

import collections
import gzip
import hashlib
import io
import os

import pytest

from relaytrail.llm import common, warc


def pages():
    long, other = "<p>" + "same text " * 30 + "</p>", "ä🙂漢" * 40
    rows = [(i, f"http://h{i % 3}.example.org/{i}", long) for i in range(9, 40)]
    rows += [(2, "http://a.example.org/x y\r\nWARC-Type: warcinfo", other), (5, None, other), (7, "http://b.example.org/é", other), (None, "http://c/", other)]
    rows += [(50, "u", None), (51, "u", ""), (52, "u", "short"), (53, "u", "short"), (54, "u", "x" * 99), (55, "u", "x" * 99), (56, "u", "y" * 100), (57, "u", "y" * 100)]
    rows += [(60, "u", "row " * 50)] * 3 + [(None, None, "z" * 200)] * 2 + [(None, None, None)]
    rows += [(70, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9), (71, "u", "big" * 700_000), (72, "v", "big" * 700_000)]
    return rows


def by_hand(rows, least=warc.LEAST):
    seen = collections.defaultdict(list)
    for page_id, _, html in rows:
        seen[(html or "").encode()].append(page_id)
    for payload, ids in seen.items():
        ids.sort(key=lambda i: (i is None, i))
        for n, page_id in enumerate(ids):
            again = n > 0 and len(payload) >= least
            yield page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None


CLASHES = "digest bytes type refers file offset length first weight payload record_id absent".split()


def frame(spark, rows):
    schema = "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], schema).repartition(4)


@pytest.mark.parametrize("hot", [common.HOT, 3])
def test_pages_come_back(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    got = warc.archived(frame(spark, pages()))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(by_hand(pages()))


def test_no_pages(spark):
    assert warc.archived(frame(spark, [])).count() == 0


def test_archives_are_warc(spark, tmp_path):
    df, raw, unique = frame(spark, pages()), str(tmp_path / "raw"), str(tmp_path / "unique")
    captures = warc.write_archives(df, raw, archive_bytes=2000)
    copies = warc.deduplicate_archives(captures, raw, unique, archive_bytes=1000).collect()
    assert len({r.file for r in copies}) > 4
    payloads = collections.Counter()
    for row in copies:
        data = open(f"{unique}/{row.file}", "rb").read()[row.offset : row.offset + row.length]
        fields, http, payload = warc.parse(gzip.decompress(data))
        assert fields["warc-type"] == row.type and int(http["content-length"]) == row.bytes
        assert ("warc-refers-to" in fields) == (row.type == "revisit") == (fields.get("warc-profile") == warc.PROFILE)
        assert fields.get("x-page-id") == (None if row.page_id is None else str(row.page_id))
        if row.type == "response":
            payloads[payload] += 1
            assert hashlib.sha256(payload).hexdigest() == row.digest
        else:
            assert payload == b""
    assert all(n == 1 for p, n in payloads.items() if len(p) >= warc.LEAST) and len(payloads) == len({r[2] or "" for r in pages()})
    # nothing but records is in the files
    for name in {r.file for r in copies}:
        ends = sorted((r.offset, r.length) for r in copies if r.file == name)
        assert [a for a, _ in ends] == [0, *[a + n for a, n in ends][:-1]] and sum(ends[-1]) == os.path.getsize(f"{unique}/{name}")
        assert sum(1 for _ in warc.members(io.BytesIO(open(f"{unique}/{name}", "rb").read()))) == len(ends)


def test_damage_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "raw")
    captures = warc.write_archives(frame(spark, pages()[:1]), folder)
    name = captures.first().file
    whole = open(f"{folder}/{name}", "rb").read()
    text = gzip.decompress(whole)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(gzip.compress(text.replace(b"same", b"some", 1)))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(captures, folder).collect()
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(whole[:-9])))
