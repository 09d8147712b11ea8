"""N-gram Jaccard self-join by adaptive multi-match prefixes.

Shingles are ordered with frequent ones last. A document of n shingles whose partners must share at least o of them
shares at least l tokens of the first n - o + l with each partner, for any l up to o; with different l, the smaller
counts. Each document picks its own l by estimated cost: a longer prefix posts more tokens, but asks for more matches
and so leaves fewer candidates. Tokens meet in buckets, packed in one row per document and bucket; documents without
enough shared prefix tokens drop out; the others meet under the smallest member of their tokens, where prefixes are
compared pair by pair. Only members of the pairs that share enough move their sets and are verified exactly. Exact
copies count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from inkwell.llm.common import checkpointed, components, map_text
from inkwell.llm.similar import attach, blocked, compatible, flood, link_groups, members, packed, shingles, signature, uncovered, unpacked

LOCAL = 4  # a shingle is reported as frequent by a task that sees it in so many different sets
SHINGLES = 2_000_000  # of about so many shingles
PART = 1000  # documents that Python looks at together


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any partner: Jaccard t needs |x & y| >= t |x|."""
    return -(-percent * n // 100)


class Frequent:
    """The most frequent shingles (sorted), how often each was seen and the set under which its sets meet."""

    def __init__(self, token: np.ndarray, count: np.ndarray, lead: np.ndarray):
        self.token, self.count, self.lead = token, count, lead

    def find(self, s: np.ndarray) -> np.ndarray:
        """Place of each shingle in the list, -1 if it is not there."""
        if not len(self.token):
            return np.full(len(s), -1)
        at = np.searchsorted(self.token, s)
        at[at == len(self.token)] = 0
        return np.where(self.token[at] == s, at, -1)


def prefix(s: np.ndarray, frequent: Frequent, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The document's number of required matches and its prefix: rare tokens, then places of frequent ones in the list.

    Estimated cost of l matches: the tokens posted, plus n for each candidate to verify; candidates are the postings of
    the prefix's frequent tokens and one chance partner for every hundred shingles, divided by the matches asked for.
    A tenth of the shingles is asked for at least, so that what a partner asks for is bounded by its size.
    """
    n = len(s)
    if not n:
        return 0, s, s
    o = least_overlap(n, percent)
    at = frequent.find(s)
    rare, at = s[at < 0], at[at >= 0]
    at = at[np.argsort(frequent.count[at], kind="stable")]  # of sorted tokens, so ties stay in order of the token
    before = np.concatenate(([0], np.cumsum(frequent.count[at])))
    tries = np.unique(np.clip(max(n // 10, 1) * 2 ** np.arange(0, 5), 1, o))
    posts = n - o + tries
    cost = posts + n * (n / 100 + before[np.maximum(posts - len(rare), 0)]) / tries
    k = int(cost.argmin())
    take = int(posts[k])
    return int(tries[k]), rare[:take], at[: max(0, take - len(rare))]


def _sets(col: pa.Array) -> Iterator[np.ndarray]:
    for t in col.to_pylist():
        yield shingles((t or b"").lower().split())


def _batch(names, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[n], pa.int64()) for n in names], names=names)


def document_sets(docs: DataFrame) -> DataFrame:
    """One row per document (id, n, sig) and, with a token, rows of shingles that a task finds frequent."""
    names = ["id", "n", "sig", "token", "c", "lead"]

    def often(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        order = sorted(sets)  # so the first set that has a token is the smallest
        tok, first, c = np.unique(np.concatenate([sets[x] for x in order]), return_index=True, return_counts=True)
        lead = np.repeat(np.array(order), [len(sets[x]) for x in order])[first]
        keep = c >= LOCAL
        none = np.zeros(int(keep.sum()), np.int64)
        return _batch(names, id=none, n=none, sig=none, token=tok[keep], c=c[keep], lead=lead[keep])

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            for at in range(0, b.num_rows, PART):
                part = b.slice(at, PART)
                n, sig = [], []
                for s in _sets(part.column("text")):
                    n.append(len(s))
                    sig.append(signature(s))
                    if len(s) and sig[-1] not in sets:
                        sets[sig[-1]] = s
                        held += len(s)
                    if held >= SHINGLES:
                        yield often(sets)
                        sets, held = {}, 0
                none = [None] * len(n)
                yield _batch(names, id=part.column("id").to_pylist(), n=n, sig=sig, token=none, c=none, lead=none)
        if sets:
            yield often(sets)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def posting_rows(sets: list[np.ndarray], frequent: Frequent, percent: int, buckets: int) -> pa.RecordBatch | None:
    """``(bucket, member, n, tokens)``: the rare prefix tokens of each set by bucket, 31 bits each and a bit for those of the
    shortest prefix, which alone meet every partner. Frequent tokens need no meeting: a row with negative ``n`` holds
    their number and the sets that lead them."""
    tok, short, own, rows = [], [], [], []
    for d, s in enumerate(sets):
        _, rare, at = prefix(s, frequent, percent)
        base = len(s) - least_overlap(len(s), percent) + 1
        tok.append(rare)
        short.append(np.arange(len(rare)) < base)
        own.append(np.full(len(rare), d))
        if len(at):
            rows.append((d, np.concatenate(([len(at)], np.unique(frequent.lead[at[: max(0, base - len(rare))]])))))
    if not tok:
        return None
    member, size = np.array([signature(s) for s in sets]), np.array([len(s) for s in sets])
    tok, short, own = np.concatenate(tok), np.concatenate(short), np.concatenate(own)
    bucket = ((tok.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, own = bucket[order], own[order]
    cuts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])))) if len(tok) else np.zeros(0, np.int64)
    kept = packed(((tok & 0x7FFFFFFF) << 1 | short).astype(np.uint32)[order], cuts)
    hot = np.array([d for d, _ in rows], np.int64)
    lead = packed(np.concatenate([x for _, x in rows] or [np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum([len(x) for _, x in rows])))[:-1].astype(np.int64))
    cols = np.append(bucket[cuts], member[hot] % buckets), np.append(member[own[cuts]], member[hot]), np.append(size[own[cuts]], -size[hot])
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2]), pa.concat_arrays([kept, lead])], names=["bucket", "member", "n", "tokens"])


def meet(t: pa.Table, percent: int) -> pa.Table:
    """What the tokens of one bucket say: per member its size, how many of its tokens a set of about its size has too, and
    the smallest members of the tokens of its shortest prefix."""
    member, n = t.column("member").to_numpy(), t.column("n").to_numpy()
    col = t.column("tokens").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    out = []
    for hot in (False, True):  # copies that several tasks posted count once
        rows = np.flatnonzero((n < 0) == hot)
        rows = rows[np.unique(member[rows], return_index=True)[1]]
        who, size = member[rows], np.abs(n[rows])
        value, lens = unpacked(col.take(pa.array(rows)), np.int64 if hot else np.uint32)
        own = np.repeat(np.arange(len(rows)), lens)
        if hot:
            first = np.concatenate(([0], np.cumsum(lens)))[:-1]
            count, lead = value[first], np.delete(value, first)
            out.append((who, size, count, own[np.delete(np.arange(len(own)), first)], lead))
            continue
        order = np.argsort((value >> 1).astype(np.int64) << 32 | np.minimum(size[own], 0xFFFFFFFF))
        value, own = value[order], own[order]
        token, s = value >> 1, size[own]
        near = (token[1:] == token[:-1]) & (s[:-1] * 100 >= s[1:] * percent)
        fits = np.concatenate((near, [False])) | np.concatenate(([False], near)) if len(token) else np.zeros(0, bool)
        count = np.bincount(own[fits], minlength=len(rows))
        some = fits & (value & 1 == 1)
        token, own = token[some], own[some]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        lens = np.diff(np.append(start, len(token)))
        lead = np.repeat(np.minimum.reduceat(who[own], start), lens) if len(start) else np.zeros(0, np.int64)
        own, lead = own[np.repeat(lens > 1, lens)], lead[np.repeat(lens > 1, lens)]
        out.append((who, size, count, own, lead))
    parts = []
    for who, size, count, own, lead in out:
        order = np.lexsort((lead, own))
        own, lead = own[order], lead[order]
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (lead[1:] != lead[:-1]))) if len(own) else np.zeros(0, bool)
        own, lead = own[fresh], lead[fresh]
        has = np.flatnonzero(count > 0)
        ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(who))[has]))).astype(np.int32)
        parts.append(pa.table([pa.array(who[has], pa.int64()), pa.array(size[has], pa.int64()), pa.array(count[has], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(lead, pa.int64()))], names=["member", "n", "k", "leaders"]))
    return pa.concat_tables(parts)


def prefix_row(s: np.ndarray, frequent: Frequent, percent: int) -> np.ndarray:
    """The matches that a set asks for, its size, and 32 bits of each prefix token. Tokens alike in these bits are kept, so
    that shared tokens may be counted too high, never too low."""
    need, rare, at = prefix(s, frequent, percent)
    return np.concatenate(([need, len(s)], np.sort(np.concatenate((rare, frequent.token[at])) & 0xFFFFFFFF))).astype(np.uint32)


def near_members(t: pa.Table, percent: int) -> pa.Table:
    """Members of a block pair whose prefixes share what one of the two asks for, with the smallest member that such pairs
    connect them to."""
    node, rows = members(t, np.uint32)
    need, size = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    root = flood([r[2:] for r in rows], percent, size, lambda i, rest, both: both >= np.minimum(need[i], need[rest]))
    several = np.bincount(root, minlength=len(root))[root] > 1
    return pa.table({"leader": pa.array(node[root[several]], pa.int64()), "member": pa.array(node[several], pa.int64())})


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, min_frequent: int = 16, max_frequent: int = 200_000, bucket_shingles: int = 8_000_000) -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (the smallest id reachable by links of ``percent``), ``sig`` (the
    signature of its set) and ``first``: its set and id are those that stand for the component, or it links with nothing.

    Null, empty and wordless texts have no shingles, link with nothing and are their own component. Rows of a repeated
    id are judged each by its text. A null id has a null component and links nothing. An empty table gives no rows;
    extra columns are ignored. ``max_frequent`` bounds the list of frequent shingles sent to the tasks; it shapes the
    order of tokens, never the result; a frequent shingle's sets meet under a set named in the list, so no task has to hold
    them. ``bucket_shingles`` is about how many shingles share a bucket, three tenths of which are posted.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    seen = checkpointed(document_sets(src))
    rows = seen.where("token is null").select("id", "n", "sig")
    top = seen.where("token is not null").groupBy("token").agg(F.sum("c").alias("c"), F.min("lead").alias("lead")).where(F.col("c") >= min_frequent)
    top = top.orderBy(F.desc("c"), "token").limit(max_frequent).toPandas().sort_values("token")
    frequent = Frequent(*(top[c].to_numpy(np.int64) for c in ("token", "c", "lead")))
    classes = rows.where("n > 0 and id is not null").groupBy("sig", "n").agg(F.min("id").alias("node"))
    buckets = max(64, (classes.agg(F.sum("n")).first()[0] or 0) // bucket_shingles)

    def post(batches):
        done: set[int] = set()  # copies in this task post once
        for b in batches:
            for at in range(0, b.num_rows, PART):
                fresh = {signature(s): s for s in _sets(b.column("text").slice(at, PART)) if len(s)}
                made = posting_rows([s for sig, s in fresh.items() if sig not in done], frequent, percent, buckets)
                if len(done) >= 1_000_000:
                    done.clear()
                done.update(fresh)
                if made is not None:
                    yield made

    # Every prefix token meets its like in its bucket; what comes back is one row per member and bucket.
    posted = src.where("id is not null").mapInArrow(post, "bucket int, member long, n long, tokens binary")
    met = posted.groupBy("bucket").applyInArrow(lambda t: meet(t, percent), "member long, n long, k long, leaders array<long>")
    needs = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * F.lit(percent) / 100) / 10))  # the least that a partner of the size asks for
    whole = met.groupBy("member").agg(F.sum("k").alias("k"), F.first("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("leaders"))).alias("leaders"))
    groups = uncovered(checkpointed(whole.where(F.col("k") >= needs).select(F.explode("leaders").alias("leader"), "member", "n")))

    def inside(groups: DataFrame, pack) -> DataFrame:
        """What ``pack`` makes of each member's set, in every block pair of its groups."""
        places = blocked(groups).groupBy("member").agg(F.collect_list(F.struct("leader", "i", "j")).alias("places"))
        wanted = checkpointed(classes.withColumnRenamed("sig", "member").join(places, "member").select(F.col("node").alias("id"), F.col("member").alias("want"), "places"))

        def load(batches):
            for b in batches:
                for part in (b.slice(at, PART) for at in range(0, b.num_rows, PART)):
                    kept, tokens = [], []
                    for k, (want, s) in enumerate(zip(part.column("want").to_pylist(), _sets(part.column("text")), strict=True)):
                        if signature(s) == want:
                            kept.append(k)
                            tokens.append(pack(s).tobytes())
                    rows = part.take(pa.array(kept, pa.int64()))
                    yield pa.RecordBatch.from_arrays([rows.column("want"), rows.column("places"), pa.array(tokens, pa.binary())], names=["node", "places", "tokens"])

        sets = attach(src, wanted, "id").select("want", "text", "places").mapInArrow(load, "node long, places array<struct<leader long, i int, j int>>, tokens binary")
        return sets.select(F.explode("places").alias("p"), "node", "tokens").select("p.leader", "p.i", "p.j", "node", "tokens")

    # Members that share enough of their prefixes with another one form groups under the smallest of them.
    prefixes = inside(compatible(groups, percent), lambda s: prefix_row(s, frequent, percent))
    near = prefixes.groupBy("leader", "i", "j").applyInArrow(lambda t: near_members(t, percent), "leader long, member long")
    edges = link_groups(inside(uncovered(checkpointed(near.distinct())), lambda s: s), percent)
    found = components(edges).withColumnRenamed("node", "sig")
    named = classes.join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = named.groupBy("component").agg(F.min(F.struct("node", "sig")).alias("of"))
    named = named.join(smallest, "component").select("sig", "n", F.col("of.node").alias("component_id"), (F.col("of.sig") == F.col("sig")).alias("smallest"))
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    return rows.join(named, ["sig", "n"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "sig",
        F.when(linked, F.col("smallest") & (F.col("component_id") == F.col("id"))).otherwise(True).alias("first"),
    )


def with_signature(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``sig`` and ``n_shingles`` of each row's set, as :func:`link_documents` names them."""

    def run(texts):
        sets = [shingles((t or b"").lower().split()) for t in texts]
        return {"sig": [signature(s) for s in sets], "n_shingles": [len(s) for s in sets]}

    return map_text(docs, text_col, docs.columns, [T.StructField("sig", T.LongType()), T.StructField("n_shingles", T.LongType())], run)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, **limits: int) -> DataFrame:
    """Per document: its id, ``n_shingles`` and ``component_id``, the smallest id reachable by links of ``percent``; cases
    and ``limits`` as in :func:`link_documents`."""
    return link_documents(docs, id_col, text_col, percent, **limits).select(id_col, "n_shingles", "component_id")
