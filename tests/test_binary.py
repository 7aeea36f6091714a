"""Identifiers in binary files over ranges of every size: across cuts, at both ends, with words around them, and bytes that are no text."""

from __future__ import annotations

import re

import pytest

from tarmac.sources.binary import IDENTIFIER, scan_ranges

TEXT = "1999-01-02x 2000-01-02 é2001-01-02 2002-01-02é 12003-01-02 2004-01-023 2005-01-02\n2006-01-02,2006-01-02 \U0001f600 2007-01-02-08 99-2008-01-02"


@pytest.mark.parametrize("charset", ["utf-16le", "utf-8", "latin-1"])
@pytest.mark.parametrize("size", [2, 7, 26, 1000])
def test_each_is_found_once(spark, tmp_path, charset, size):
    text = TEXT if charset != "latin-1" else TEXT.replace("\U0001f600", "?")
    data = text.encode(charset)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "one.bin").write_bytes(data)
    (tmp_path / "f" / "empty.bin").write_bytes(b"")
    want, decoded = [], data.decode(charset)
    for m in re.finditer(IDENTIFIER, decoded):
        want.append((len(decoded[: m.start()].encode(charset)), m[1]))
    got = sorted((r["start"], r["id"]) for r in scan_ranges(spark, f"file://{tmp_path}/f", charset, size).collect())
    assert got == want and len(want) >= 5


def test_bytes_that_are_no_text(spark, tmp_path):
    noise = bytes(range(256)) * 3
    (tmp_path / "x.bin").write_bytes(noise + "  1999-01-02 ".encode("utf-16le") + noise)
    assert [r["id"] for r in scan_ranges(spark, f"{tmp_path}/x.bin", range_bytes=64).collect()] == ["1999-01-02"]
    (tmp_path / "y.bin").write_bytes(noise + b" 1999-01-02 " + noise)
    assert [r["id"] for r in scan_ranges(spark, f"{tmp_path}/y.bin", "utf-8", range_bytes=50).collect()] == ["1999-01-02"]
    with pytest.raises(Exception, match="nothing"):
        scan_ranges(spark, f"{tmp_path}/nothing").collect()
