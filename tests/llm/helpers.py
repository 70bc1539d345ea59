"""Brute-force counterparts that the tests hold the operators against."""

from __future__ import annotations

import re
from itertools import combinations

import duckdb

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest_reachable(nodes, edges):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        at[b] = a
    return {n: top(n) for n in nodes}


def near_components(docs):
    """{doc_id: smallest doc_id reachable} over all pairs of (doc_id, text)."""
    sets = [(d, shingle_set(t)) for d, t in docs if d is not None]
    edges = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return smallest_reachable({d for d, _ in sets}, edges)


def duck(sql, tables, sf=SF):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = c.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same_rows(df, columns, rows):
    assert sorted(df.columns) == sorted(columns)
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=order) == sorted((tuple(r) for r in rows), key=order)
