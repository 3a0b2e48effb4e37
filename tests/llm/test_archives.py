"""Foreign archives: damaged members, very many members, header names in any case."""

import gzip
import random
import time
import zlib

import pytest

from heron.llm import warc


def record(n, body, names=("WARC-Type", "Content-Length")):
    return f"WARC/1.0\r\n{names[0]}: response\r\nWARC-Target-URI: https://a.org/{n}\r\n{names[1]}: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def records(n, size=300):
    r = random.Random(n)
    return [record(k, bytes(r.choices(b"abcdefgh <>", k=size))) for k in range(n)]


def test_members_whole():
    some = records(5)
    for data in (b"".join(map(gzip.compress, some)), gzip.compress(b"".join(some)), b"".join(some), b""):
        assert warc.unzipped(data) == (b"".join(some) if data else b"")
    named = b"\x1f\x8b\x08\x1c\0\0\0\0\0\3\2\0xy" + b"name\0comment\0" + zlib.compress(some[0], wbits=-15) + bytes(8)
    assert warc.unzipped(named + gzip.compress(some[1])) == some[0] + some[1]


@pytest.mark.parametrize("where", ["checksum", "length", "cut"])
def test_a_damaged_middle_member_costs_itself_at_most(where):
    some = records(3, 30000)
    first, middle, last = map(gzip.compress, some)
    if where == "cut":
        middle = middle[: len(middle) // 2]
    else:
        at = -8 if where == "checksum" else -1
        middle = middle[:at] + bytes([middle[at] ^ 255]) + middle[len(middle) + at + 1 :]
    got = warc.unzipped(first + middle + last)
    if where == "cut":
        # what follows a cut is read as its rest until it can't be; the last member is found all the same
        assert got.startswith(some[0] + some[1][:9000]) and got.endswith(some[2])
    else:
        assert got == b"".join(some)


def test_damage_within_a_member():
    some = records(4, 20000)
    members = [gzip.compress(s) for s in some]
    r = random.Random(9)
    for _ in range(20):
        hurt = bytearray(members[1])
        hurt[r.randrange(12, len(hurt) - 8)] ^= 1 << r.randrange(8)
        got = warc.unzipped(members[0] + bytes(hurt) + members[2] + members[3])
        assert got.startswith(some[0]) and some[2] in got and got.endswith(some[3])


def test_a_broken_tail():
    data = gzip.compress(records(1, 50000)[0])
    whole = zlib.decompress(data, wbits=31)
    assert whole.startswith(got := warc.unzipped(data[:-2000])) and len(got) > len(whole) // 2
    assert warc.unzipped(b"\x1f\x8b\x08") == b"" and warc.unzipped(b"\x1f\x8b\x08\x08" + bytes(6) + b"no end") == b""


def test_fifty_thousand_members():
    one = gzip.compress(record(1, b"x" * 400))
    began = time.time()
    assert len(warc.unzipped(one * 50000)) == 50000 * len(record(1, b"x" * 400))
    assert time.time() - began < 60


def test_header_names_in_any_case(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1, b"one", ("warc-type", "content-length")) + record(2, b"two", ("WARC-TYPE", "CONTENT-LENGTH"))))
    out = sorted((r["target"], r["kind"], bytes(r["body"])) for r in warc.foreign(spark, str(tmp_path)).collect())
    assert out == [("https://a.org/1", "response", b"one"), ("https://a.org/2", "response", b"two")]
