"""Schemas of the ten tables. 0 stands for "none" in the id columns of ``comment``."""

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_T = {"long": LongType(), "int": IntegerType(), "string": StringType(), "ts": TimestampType(), "bool": BooleanType()}


def _schema(text: str) -> StructType:
    return StructType([StructField(n, _T[t]) for n, t in (c.split(":") for c in text.split())])


TIMES = "create_time:ts update_time:ts"

SCHEMAS = {
    "tag": _schema("id:long name:string"),
    "article": _schema(f"id:long title:string summary:string content:string view_num:long status:string published_id:long published_time:ts {TIMES} tag_id:long"),
    "article_image": _schema(f"id:long object_key:string url:string image_name:string mime:string size:long etag:string status:string {TIMES}"),
    "article_image_reference": _schema(f"id:long image_id:long article_id:long ref_type:string ref_count:int {TIMES}"),
    "comment": _schema(f"id:long article_id:long parent_id:long user_id:long reply_to_user_id:long reply_to_comment_id:long author_name:string content:string status:string moderation_reasons:string ip:string {TIMES}"),
    "comment_report": _schema(f"id:long comment_id:long article_id:long reporter_id:long reason:string status:string ip:string {TIMES}"),
    "user": _schema(f"id:long provider:string provider_user_id:string display_name:string handle:string avatar_url:string profile_url:string email:string comment_disabled:bool disabled_reason:string disabled_until:ts session_version:long {TIMES}"),
    "link": _schema(f"id:long name:string url:string {TIMES}"),
    "site_dynamic": _schema(f"id:long content:string status:string sort_order:int event_time:ts {TIMES}"),
    "admin": _schema("id:long about_me_info:string web_site_info:string contact_me_info:string"),
}

#: Columns that identify a row besides its id.
UNIQUE = {
    "tag": [["name"]],
    "article": [["published_id"]],
    "article_image": [["object_key"]],
    "article_image_reference": [["image_id", "article_id", "ref_type"]],
    "comment_report": [["comment_id", "reporter_id"]],
    "user": [["provider", "provider_user_id"], ["handle"]],
    "link": [["name"], ["url"]],
}
