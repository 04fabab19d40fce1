from __future__ import annotations

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def least_reachable(ids, pairs):
    """Smallest id reachable from each id by the pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(rng, n, words=120, edits=8):
    """n texts in families of near copies."""
    out = []
    base = [rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(words)]
    for _ in range(n):
        if rng.random() < 0.3:
            base = [rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(rng.randrange(3, words))]
        one = list(base)
        for _ in range(rng.randrange(edits)):
            one[rng.randrange(len(one))] = "edit" + str(rng.randrange(9999))
        out.append((" " if rng.random() < 0.5 else "\n").join(one))
    return out
