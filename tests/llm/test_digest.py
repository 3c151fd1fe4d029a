import zlib

from lodestone.llm import fingerprint


def test_short_texts_have_digests_of_their_own():
    for a, b in ((b"abc", b"xyz"), (b"abcd", b"abce"), (b"ab", b"xy"), (b"a", b"b")):
        marks = fingerprint.digest(a), fingerprint.digest(b)
        assert marks[0] != marks[1] and fingerprint.likeness(*marks) < 1
    assert [fingerprint.bucket_counts(b"abcdefg"[:n]).sum() for n in range(8)] == [0, 0, 0, 1, 3, 3, 6, 9]


def test_digest_begins_with_a_checksum():
    data = b"some words of a text, and some more"
    mark = fingerprint.digest(data)
    assert len(mark) == 6 + fingerprint.BUCKETS // 2 and int(mark[:2], 16) == zlib.crc32(data) & 0xFF
    other = f"{int(mark[:2], 16) ^ 1:02x}{mark[2:]}"
    assert fingerprint.likeness(mark, other) == 1 - 1 / fingerprint.MOST
