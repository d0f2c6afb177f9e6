"""Small helpers of the tests."""

import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
