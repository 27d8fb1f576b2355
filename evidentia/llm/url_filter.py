"""URL filter: explicit host and path rules first, else logistic regression on character n-grams.

The rules are column expressions. The regression sees hashed character n-grams of host and path and is trained in numpy on
a small labelled table, ``LABELLED`` unless another is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import bounded

BITS = 15
NGRAMS = (3, 4, 5)
CUT = 0.5
_SCALE = 1 << 20
_BYTES = A.byte_values()

#: (rule, verdict): a host, which covers its subdomains, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Small labelled table, invented: 1 is unwanted. Its hosts are under names reserved for tests.
LABELLED = (
    *((u, 1) for u in (
        "http://casino-bonus.invalid/win", "https://www.spam-links.test/en/12", "http://cheap-pills.invalid/buy-now", "https://free-money.test/claim",
        "http://adult-cams.invalid/live", "https://porn-videos.test/xxx/1", "http://poker-bet.invalid/play", "https://spam-blog.invalid/page/9",
        "http://payday-loans.test/apply", "https://www.link-farm.invalid/en/55", "http://viagra-shop.test/order", "https://fake-watches.invalid/sale",
        "http://malware-host.test/setup.exe", "https://click-bait.invalid/you-wont-believe", "http://blog.spam-mail.test/fr/8", "https://seo-farm.invalid/de/3",
        "http://torrent-warez.test/crack", "https://bet-casino.test/en/slots", "http://xxx-dating.invalid/join", "https://m.content-farm.test/es/77.html",
        "http://www.spam-ads.invalid/en/4?ref=x", "https://phish-login.test/verify", "http://ad-farm.test/en/901", "https://spam-pages.invalid/fr/31",
    )),
    *((u, 0) for u in (
        "https://blog.garden.test/en/12", "http://m.news.invalid/de/404.html", "https://docs.library.test/es/7", "https://wiki.history.invalid/en/88/",
        "http://weather-station.test/en/671", "https://m.orchard.invalid/en/25", "https://blog.north-coast.test/fr/31.html", "http://lantern.invalid/es/990",
        "https://school.test/en/course/3", "http://museum.invalid/de/saal/5", "https://www.river-trust.test/en/today", "https://recipes.invalid/fr/soupe/2",
        "http://www.thornton.test/en/474.html", "https://m.henderson.invalid/de/8", "http://blog.atherton.invalid/en/853/", "https://www.station.invalid/es/533/",
        "https://research.test/paper/1", "http://city-hall.invalid/en/map", "https://music.test/fr/album/6", "http://health.invalid/en/advice",
        "https://www.theatre.test/fr/825", "http://nation-park.invalid/en/728", "https://m.weaving.test/en/9", "https://blog.bookshop.invalid/de/61",
    )),
)


def parts(url) -> tuple[F.Column, F.Column]:
    """Host (ASCII letters lower-cased) and path of a URL column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule, and its verdict, whose host is the URL's or a parent of it and whose path starts the URL's.

    Null where no rule fits; of equally long rules the first in order of text counts.
    """
    named, verdicts = [], []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        named.append(F.when(fits, F.lit(rule)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    none = F.lit(None).cast("string")
    return F.coalesce(*named, none), F.coalesce(*verdicts, none)


def _features(buf: np.ndarray, off: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    value = _BYTES[buf]
    for n in NGRAMS:
        g = A.window_hash(value, n, seed=n)
        if len(g):
            at = np.flatnonzero(A.window_mask(off, n))
            yield (g[at] >> np.uint64(64 - bits)).astype(np.int64), at


def _text(host: str, path: str) -> bytes:
    return f"^{host}${path}$".encode()


class Regression:
    """Weights in fixed point, so a URL's score does not depend on its batch."""

    def __init__(self, bits: int = BITS):
        self.bits, self.weights, self.bias = bits, np.zeros(1 << bits, np.int64), 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for bucket, at in _features(buf, off, self.bits):
            edges = np.searchsorted(at, off)
            sums = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(self.weights[bucket], out=sums[1:])
            total += sums[edges[1:]] - sums[edges[:-1]]
            count += np.diff(edges)
        return total / _SCALE / np.sqrt(np.maximum(count, 1)) + self.bias

    def train(self, texts: list[bytes], labels: list[int], epochs: int = 300, rate: float = 1.0, decay: float = 0.002) -> Regression:
        """Full-batch gradient descent on the log loss with L2 decay; features scaled by 1/sqrt(count)."""
        x = np.zeros((len(texts), 1 << self.bits), np.float32)
        for k, t in enumerate(texts):
            for bucket, _ in _features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), self.bits):
                np.add.at(x[k], bucket, 1)
            x[k] /= np.sqrt(max(1.0, x[k].sum()))
        y, w, b = np.array(labels, np.float32), np.zeros(1 << self.bits, np.float32), 0.0
        for _ in range(epochs):
            p = 1 / (1 + np.exp(-(x @ w + b)))
            w -= rate * (x.T @ (p - y) / len(y) + decay * w)
            b -= rate * float((p - y).mean())
        self.weights, self.bias = np.rint(w * _SCALE).astype(np.int64), b
        return self


def _split(url: str) -> tuple[str, str]:
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (m[1].lower(), m[2]) if m else ("", "")


def fit(labelled=LABELLED, bits: int = BITS) -> Regression:
    return Regression(bits).train([_text(*_split(u)) for u, _ in labelled], [y for _, y in labelled])


def _scores(model: Regression):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = model.logits([_text(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])
            score = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            yield pa.record_batch([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def judge(pages: DataFrame, model: Regression, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (or null), verdict and the regression's score of every row.

    Null URL, or one without ``://``: empty host and path, judged by the regression on
    these. A URL of any length is judged whole. Repeated rows each get their own row;
    extra columns are ignored.
    """
    host, path = parts(F.col("url"))
    rows = bounded(pages).select("page_id", host.alias("host"), path.alias("path"))
    scored = rows.mapInArrow(_scores(model), "page_id long, host string, path string, score double")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("score") >= CUT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")
