"""Helpers of these tests."""

import re


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


ODD = [None, "", " \n\t ", "a", "A a A a", "é" * 3, "x " * 30000, "same text again", "same text again"]
