"""Full texts of long licences are found by their digests."""

from pathlib import Path

import pytest

from gridloom.llm import licenses
from gridloom.llm.license_texts import DIGESTS

from .conftest import make

FOLDER = Path("/usr/share/common-licenses")
KNOWN = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts")
def test_full_texts(spark):
    texts = {k: (FOLDER / f).read_text() for k, f in enumerate(KNOWN)}
    rows = [(k, t, None) for k, t in texts.items()] + [(100 + k, t.upper() + "\nmore", None) for k, t in texts.items()]
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(make(spark, rows)).collect()}
    assert [got[k] for k in texts] == list(KNOWN.values())
    assert all(got[100 + k] is None for k in texts) and len(DIGESTS) == len(KNOWN)
