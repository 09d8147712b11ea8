"""Host-level quality rules: failures by host, shrunk with an empirical beta prior, joined back to the documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkwell.llm.common import checkpointed, map_text

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

#: rule name -> failure condition over the metrics, each in integers so that every engine agrees.
RULES = {
    "short": "n_words < 10",
    "repeated": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE_RULES = ("short", "repeated")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice (every occurrence counts)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words))
    code, k = ids, 1
    while k < window:  # code[i] stands for the k words from i; renumbered before it could overflow
        size = len(seen) if k == 1 else int(code.max()) + 1
        if size * len(seen) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code[: len(ids) - k] * len(seen) + ids[k:]
        k += 1
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _metrics(texts: list[bytes | None]) -> dict[str, list[int]]:
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")}
    for text in texts:
        text = text or b""
        words = text.split()
        kept = text.translate(None, _SPACES)
        lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(kept.decode("utf-8", "replace")))
        out["n_symbols"].append(len(text) - len(text.translate(None, _SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_lines"].append(len(lines))
        out["n_repeat_words"].append(repeat_words(words))
    return out


def document_metrics(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """Exact per-document counts in one Arrow pass. Null and empty texts count zero everywhere."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    return map_text(docs, text_col, carry, [T.StructField(n, T.LongType()) for n in names], _metrics)


def host_verdicts(failures: DataFrame, host_col: str, rules: list[str], max_rate: float, min_strength: float = 2.0, max_strength: float = 1000.0) -> DataFrame:
    """One row per host: documents, failures and shrunk failure rate of each rule, and ``host_ok``.

    The beta prior of a rule is fitted to all hosts by moments: mean and variance of the host rates give its strength,
    held between ``min_strength`` and ``max_strength`` documents. Hosts with few documents thus lean on the others.
    """
    hosts = checkpointed(failures.groupBy(host_col).agg(F.count("*").alias("n_docs"), *[F.count_if(F.col(f"fail_{r}")).alias(f"n_{r}") for r in rules]))
    rate = lambda r: F.col(f"n_{r}") / F.col("n_docs")
    prior = hosts.agg(*[x for r in rules for x in (F.avg(rate(r)).alias(f"m_{r}"), F.var_pop(rate(r)).alias(f"v_{r}"))]).first()
    ok: Column = F.lit(True)
    for r in rules:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, min_strength), max_strength) if v > 0 else max_strength
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"n_{r}") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength)))
        ok = ok & (F.col(f"rate_{r}") <= max_rate)
    return hosts.withColumn("host_ok", ok)


def host_quality(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = 0.5) -> DataFrame:
    """Per document: its id and host, the metrics, ``base_failed``, the host's verdict ``host_ok`` and ``kept``.

    A document is kept if it passes the base rules and no rule's shrunk failure rate at its host exceeds ``max_rate``.
    Null hosts form one host of their own. Null and empty texts have no words and fail. Repeated rows are judged alike
    and each counts. Other input columns are not carried. An empty table gives no rows.
    """
    m = document_metrics(docs.select(F.col(id_col), F.col(host_col), F.col(text_col)), [id_col, host_col], text_col)
    for r, sql in RULES.items():
        m = m.withColumn(f"fail_{r}", F.expr(sql))
    m = checkpointed(m)
    verdicts = host_verdicts(m, host_col, list(RULES), max_rate).select(F.col(host_col).alias("__host"), "host_ok")
    failed = F.lit(False)
    for r in BASE_RULES:
        failed = failed | F.col(f"fail_{r}")
    joined = m.join(verdicts, F.col(host_col).eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))
