"""The same results by plain loops over small inputs."""

from __future__ import annotations

import math
from collections import defaultdict


def by_item(train):
    vectors = defaultdict(dict)
    for user, item, rating in train:
        vectors[item][user] = rating
    return {item: v for item, v in vectors.items() if any(v.values())}


def cosine(x, y):
    dot = sum(r * y[u] for u, r in x.items() if u in y)
    return dot / math.sqrt(sum(r * r for r in x.values()) * sum(r * r for r in y.values()))


def predictions(train, test, similar=lambda i, j, s: s > 0):
    vectors = by_item(train)
    owned = defaultdict(dict)
    for user, item, rating in train:
        owned[user][item] = rating
    found = {}
    for user, item, actual in test:
        if item not in vectors:
            continue
        top = mass = 0.0
        for other, rating in owned[user].items():
            if other == item or other not in vectors:
                continue
            s = cosine(vectors[item], vectors[other])
            if similar(item, other, s):
                top, mass = top + s * rating, mass + abs(s)
        if mass > 0:
            found[user, item] = (round(top / mass, 6), actual)
    return found


def scored_map(df):
    rows = df.collect()
    found = {(r["userId"], r["itemId"]): (round(r["pred_rating"], 6), r["actual_rating"]) for r in rows}
    assert len(found) == len(rows)
    return found
