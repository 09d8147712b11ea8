"""Image references in articles: extraction, object keys, reference sync, status, asset audit."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: a Markdown image and its address.
MARKDOWN_IMAGE = r"""!\[[^\]]*]\(\s*(<[^>]+>|[^\s)]+)(?:\s+["'][^"']*["'])?\s*\)"""
#: Media types by file extension.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "svg": "image/svg+xml"}


class _Images(HTMLParser):
    def __init__(self):
        super().__init__()
        self.urls: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag != "img":
            return
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if found.get("src"):
            self.urls.append(found["src"])
        self.urls += [part.split()[0] for part in found.get("srcset", "").split(",") if part.split()]

    handle_startendtag = handle_starttag


def html_images(content: str) -> list[str]:
    """Addresses of ``<img>`` elements and of each of their ``srcset`` candidates."""
    if "<" not in content:
        return []
    p = _Images()
    p.feed(content)
    p.close()
    return p.urls


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "^[<>]+|[<>]+$", "")


def extract_image_refs(articles: DataFrame, html: bool = True) -> DataFrame:
    """``(article_id, url, ref_type, ref_count)`` of the images in Markdown and HTML; data addresses are dropped."""
    markdown = articles.select("article_id", F.explode(F.regexp_extract_all("content", F.lit(MARKDOWN_IMAGE), 1)).alias("url"), F.lit("markdown").alias("ref_type"))
    found = markdown
    if html:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                urls = f["content"].map(html_images)
                yield pd.DataFrame({"article_id": f["article_id"], "url": urls}).explode("url").dropna(subset="url")[["article_id", "url"]]

        tagged = articles.where(F.lower("content").contains("<img")).select("article_id", "content").mapInPandas(run, "article_id long, url string")
        found = markdown.unionByName(tagged.withColumn("ref_type", F.lit("html")))
    found = found.withColumn("url", _cleaned(F.col("url"))).where((F.col("url") != "") & ~F.lower("url").startswith("data:"))
    return found.groupBy("article_id", "url", "ref_type").agg(F.count("*").alias("ref_count"))


def clean_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts, relative to its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(kept, "/")


def object_key(url: Column, base: str, directory: str = "") -> Column:
    """The storage key of an address under ``base``: same host, path below the base path, decoded and cleaned. Else null."""
    b = urlsplit(base)
    base_path = b.path.rstrip("/")
    text = F.trim(url)
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    inside = (path == base_path) | path.startswith(base_path + "/") if base_path else F.lit(True)
    rest = F.regexp_replace(F.substring(path, len(base_path) + 1, 1 << 30), "^/+", "")
    plain = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    key = clean_path(plain)
    return F.when((host == b.netloc.lower()) & inside & (plain != ""), F.concat(F.lit(directory.strip("/") + "/"), key) if directory.strip("/") else key)


def sync_image_refs(articles: DataFrame, images: DataFrame, refs: DataFrame, base: str, directory: str = "", html: bool = True) -> tuple[DataFrame, DataFrame]:
    """References of the given articles recomputed: ``(new references, images to insert)``.

    ``refs(article_id, object_key, ref_type, ref_count)``: rows of other articles stay. Keys without an image give an
    image row with the name, media type and status of a used image.
    """
    found = extract_image_refs(articles, html).withColumn("object_key", object_key(F.col("url"), base, directory)).where("object_key is not null")
    fresh = found.groupBy("article_id", "object_key", "ref_type").agg(F.sum("ref_count").alias("ref_count"))
    others = refs.join(articles.select("article_id").distinct(), "article_id", "left_anti").select(*fresh.columns)
    keys = found.groupBy("object_key").agg(F.min("url").alias("url")).join(images.select("object_key"), "object_key", "left_anti")
    extension = F.lower(F.regexp_extract("object_key", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[extension], F.lit(""))
    inserts = keys.select("object_key", "url", F.regexp_extract("object_key", r"([^/]*)$", 1).alias("image_name"), mime.alias("mime"), F.lit("used").alias("status"))
    return others.unionByName(fresh), inserts


def refresh_image_status(images: DataFrame, refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of the touched images by whether a reference is left; other images keep theirs."""
    touched = ids.select(F.col(ids.columns[0]).alias("id"), F.lit(True).alias("__touched")).distinct()
    used = refs.select(F.col("image_id").alias("id"), F.lit(True).alias("__used")).distinct()
    out = images.join(touched, "id", "left").join(used, "id", "left")
    status = F.when(F.col("__touched").isNull(), F.col("status")).when(F.col("__used"), "used").otherwise("unused")
    return out.withColumn("status", status).select(*images.columns)


DANGEROUS_SVG = r"(?is)<\s*(script|iframe|object|embed|link|meta)\b|\bon[a-z]+\s*=|javascript:"
MAX_IMAGE_BYTES = 1 << 20


def image_asset_audit(files: DataFrame) -> DataFrame:
    """Media type, verdict and reason of image files, ``files(path, content)`` as the binaryFile source gives them."""
    head = F.hex(F.substring("content", 1, 12))
    text = F.lower(F.decode(F.col("content"), "ISO-8859-1"))
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    svg = (extension == "svg") & F.substring(text, 1, 1024).contains("<svg")
    magic = (
        F.when(svg, "image/svg+xml")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )
    by_name = F.create_map(*[F.lit(x) for kv in MIME.items() if kv[0] != "svg" for x in kv])[extension]
    out = files.select("path", F.octet_length("content").cast("long").alias("size"), F.coalesce(magic, by_name).alias("mime"), svg.alias("__svg"), text.rlike(DANGEROUS_SVG).alias("__bad"))
    reason = F.when(F.col("size") > MAX_IMAGE_BYTES, "too_large").when(F.col("mime").isNull(), "unsupported").when(F.col("__svg") & F.col("__bad"), "unsafe_svg").otherwise("")
    return out.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "").drop("__svg", "__bad")


def changed_article_paths(ids: DataFrame, domain: str = "") -> DataFrame:
    """Paths, or addresses under ``domain``, of changed articles; blank ids are skipped."""
    key = F.trim(F.col(ids.columns[0]).cast("string"))
    return ids.where(key != "").select(F.concat(F.lit(domain.rstrip("/") + "/article-detail/"), key).alias("path")).distinct()
