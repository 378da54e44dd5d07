"""Saved matches before anything is known of them."""

from __future__ import annotations


def new_match(match_id: int, created_at: int, title: str = "") -> dict:
    """A saved match's row before anything is known of it."""
    return {"match_id": match_id, "created_at": created_at, "title": title, "me": None, "names": {}, "golden_point": False, "demo": False}
