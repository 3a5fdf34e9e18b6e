"""Fits the trees of ``personal_data`` on generated, labelled texts (bounded by ROWS).

Run ``python -m skyfix.llm.training.train_personal_data``; it writes models/personal_data.json.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..personal_data import FEATURES, GENERATORS, MODEL, _texts, with_base, with_candidates

#: Labelled texts made for training; a quarter is held out for the thresholds.
ROWS = 12_000
ROUNDS, DEPTH, RATE = 40, 3, 0.3
#: Least share of right ones among the held-out candidates above a threshold.
PRECISION = 0.97
#: The share of examples that only choose the thresholds; their templates are others.
HELD = 4
WORDS = "the of report call when market house water under people before number found river light open story place early value north paper small table street garden music winter".split()


def example(r: random.Random, held: bool = False) -> tuple[str, bool]:
    """A text with one candidate, and whether that is personal data. What is held out has
    formats and words before them that the trees have not seen."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    base64 = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) + r.choice(["", "=", "=="])
    mixed = lambda n: "".join(r.choice("ABCDEFGHabcdefghjkmnpqrstuvwxyz0123456789_-") for _ in range(n))
    words = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    name = lambda: r.choice(WORDS) + r.choice("._-") + r.choice(WORDS)
    makers = [
        (True, lambda: ("", f"({d(3)}) {d(3)}-{d(4)}")),
        (True, lambda: (r.choice(["call ", "phone: ", "tel ", "mobile "]), r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(6)}", d(10)]))),
        (True, lambda: ("", f"{d(3)}-{d(3)}-{d(4)}")),
        (True, lambda: (r.choice(["ssn ", "social security ", ""]), f"{d(3)}-{d(2)}-{d(4)}")),
        (True, lambda: (r.choice(["passport ", "tax id "]), d(9))),
        (True, lambda: (r.choice(["iban ", "account ", "transfer to ", ""]), f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)}" + "".join(r.choice([" ", ""]) * (i % 4 == 0) + d(1) for i in range(r.randint(14, 22))))),
        (True, lambda: (r.choice(["token = \"", "api_key=", "secret: ", "password = ", "key = \"", "bearer "]), r.choice([hexes(40), hexes(32), mixed(24), mixed(36), base64(40), base64(30)]))),
        (True, lambda: ("", r.choice(["sk_live_", "ghp_", "AKIA", "xoxb-"]) + mixed(26))),
        (True, lambda: ("", f"{name()} {r.choice(['[at]', '(at)', '[ at ]'])} {r.choice(WORDS)} {r.choice(['[dot]', '(dot)', '.'])} com")),
        (False, lambda: (r.choice(["on ", "since ", ""]), r.choice([f"20{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.19{d(2)}", f"19{d(2)}-20{d(2)}"]))),
        (False, lambda: (r.choice(["isbn ", "order ", "invoice ", "serial ", "part no ", "version "]), r.choice([d(13), d(9), f"{d(3)}-{d(6)}", f"{d(2)}.{d(3)}.{d(4)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"]))),
        (False, lambda: ("", r.choice([d(8), d(12), d(22), d(r.randint(14, 20)), d(16), f"{d(16)} {d(16)}", f"{d(4)} {d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)}"]))),
        (False, lambda: (r.choice(["", "see ", "figure "]), "-".join(r.choice(WORDS) for _ in range(4)))),
        (False, lambda: (r.choice(["http://a.example/", "/usr/lib/", "img#", "page?id=", "www.site.example/"]), r.choice([f"{name()}-{d(4)}-{name()}", f"{r.choice(WORDS)}_{d(6)}_{r.choice(WORDS)}", "x".join(d(3) for _ in range(5))]))),
        (False, lambda: (r.choice(["commit ", "checksum ", "sha256 ", "md5 "]), hexes(40))),
        (False, lambda: (r.choice(["", "in ", "see "]), "/".join([r.choice(["", "usr", "home"]), *(r.choice([r.choice(WORDS), d(4)]) for _ in range(r.randint(4, 7)))]))),
        (False, lambda: ("", r.choice(["_" * 18 + "1", "-" * 20 + "2", "1" * 20, "Donaudampfschifffahrt" + d(1)]))),
        (False, lambda: ("", f"see {r.choice(WORDS)} (at) the {r.choice(WORDS)} . {r.choice(WORDS)}")),
    ]
    unseen = [
        (True, lambda: (r.choice(["sms to ", "fax ", "whatsapp "]), r.choice([f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}/{d(3)}-{d(4)}", f"({d(4)}) {d(6)}"]))),
        (True, lambda: (r.choice(["security number ", "my ssn: "]), r.choice([f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}"]))),
        (True, lambda: (r.choice(["bank ", "swift "]), f"{r.choice(['IT', 'NL', 'PL'])}{d(2)} " + " ".join(d(4) for _ in range(4)))),
        (True, lambda: (r.choice(["auth: ", "credential='", "API_KEY='"]), r.choice([mixed(30), hexes(64), base64(48)]))),
        (True, lambda: ("", f"{name()}(at){r.choice(WORDS)}(dot){r.choice(WORDS)} (dot) org")),
        (False, lambda: (r.choice(["table ", "page ", "issue ", "sku "]), r.choice([d(8), d(10), f"{d(4)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}"]))),
        (False, lambda: (r.choice(["", "from "]), f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{d(2)} {d(2)}")),
        (False, lambda: (r.choice(["https://b.example/", "../", "#"]), r.choice([f"{d(6)}/{r.choice(WORDS)}-{r.choice(WORDS)}-{d(3)}", f"{r.choice(WORDS)}_{r.choice(WORDS)}_v{d(2)}_{r.choice(WORDS)}"]))),
        (False, lambda: (r.choice(["", "about "]), r.choice([" ".join(d(2) for _ in range(6)), d(11), d(18), f"{d(5)} {d(5)}"]))),
        (False, lambda: (r.choice(["md5: ", "commit "]), hexes(32))),
    ]
    good, make = r.choice(unseen if held else makers)
    cue, span = make()
    return f"{words(r.randint(1, 6))} {cue}{span}{r.choice(['', '.', ',', chr(34)])} {words(4)}", good


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[dict], np.ndarray]:
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), start), []

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict:
        leaf = {"value": round(float(RATE * g[at].sum() / (h[at].sum() + 1.0)), 6)}
        if depth == 0 or len(at) < 20:
            return leaf
        best, whole = (1e-3, 0, 0.0), g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for j in range(x.shape[1]):
            for cut in np.unique(x[at, j])[:-1]:
                low = at[x[at, j] <= cut]
                high = at[x[at, j] > cut]
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[high].sum() ** 2 / (h[high].sum() + 1.0) - whole
                best = max(best, (gain, j, float(cut)))
        if best[0] <= 1e-3:
            return leaf
        _, j, cut = best
        return {"feature": list(FEATURES)[j], "at": cut, "low": grow(at[x[at, j] <= cut], g, h, depth - 1), "high": grow(at[x[at, j] > cut], g, h, depth - 1)}

    def value(node: dict) -> np.ndarray:
        if "value" in node:
            return np.full(len(x), node["value"])
        return np.where(x[:, list(FEATURES).index(node["feature"])] <= node["at"], value(node["low"]), value(node["high"]))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH))
        score = score + value(trees[-1])
    return start, trees, score


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    r = random.Random(7)
    rows = [(i, *example(r, i % HELD == 0)) for i in range(ROWS)]
    made = with_candidates(with_base(_texts(spark.createDataFrame(rows, "doc_id long, text string, good boolean"), "doc_id", "text")))
    got = made.select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.k", "c.f.*").toPandas()
    y = np.array([rows[i][2] for i in got["doc_id"]], float)
    x = got[list(FEATURES)].to_numpy(float)
    held = got["doc_id"].to_numpy() % HELD == 0
    start, trees, _ = fit(x[~held], y[~held])
    model = {"start": round(start, 6), "trees": trees}

    def score(row: np.ndarray) -> float:
        total = model["start"]
        for node in trees:
            while "value" not in node:
                node = node["low" if row[list(FEATURES).index(node["feature"])] <= node["at"] else "high"]
            total += node["value"]
        return total

    s = np.array([score(row) for row in x[held]])
    thresholds = {}
    for k, kind in enumerate(GENERATORS):
        own = got["k"].to_numpy()[held] == k
        order = np.argsort(-s[own])
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = round(float(max(0.0, s[own][order][good[-1]] - 1e-6)), 6) if len(good) else 1e9
        print(kind, own.sum(), "threshold", thresholds[kind], "recall", (y[held][own] * (s[own] > thresholds[kind])).sum() / max(1, y[held][own].sum()))
    model["thresholds"] = thresholds
    MODEL.write_text(json.dumps(model, indent=1))


if __name__ == "__main__":
    main()
