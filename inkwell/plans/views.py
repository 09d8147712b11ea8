"""Site tables derived from the driver's tables. The same statements run on Spark and in the SQL used for checking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "tag": "select * from (values (1,'en'),(2,'de'),(3,'fr'),(4,'es'),(5,'unused')) t(id,name)",
    "article": """select doc_id+1 as id, substr(text,1,60) as title, substr(text,1,120) as summary, text as content, (doc_id*37)%1000 as view_num,
  case when doc_id%10=9 then 'draft' else 'published' end as status, case when doc_id%20=19 then doc_id-18 end as published_id,
  case when doc_id%13=0 then null when lang='en' then 1 when lang='de' then 2 when lang='fr' then 3 else 4 end as tag_id,
  timestamp '2020-01-01 00:00:00' + interval '7' hour * doc_id as create_time,
  timestamp '2020-01-02 00:00:00' + interval '7' hour * doc_id as update_time from documents""",
    "site_user": """select c_custkey+1 as id, case when c_custkey%2=0 then 'github' else 'google' end as provider,
  cast(c_custkey*7919 as string) as provider_user_id, c_name as display_name,
  case when c_custkey%50=0 then concat('u', cast(c_custkey as string)) else lpad(cast(c_custkey+1 as string),5,'0') end as handle,
  c_custkey%9=0 as comment_disabled, case when c_custkey%18=0 then null else timestamp '2024-01-01 00:00:00' + interval '1' day * (c_custkey%60) end as disabled_until,
  1+c_custkey%3 as session_version, timestamp '2023-06-01 00:00:00' + interval '1' hour * c_custkey as create_time from customer""",
    "comment": """select conv_id*100+turn+1 as id, conv_id%97+1 as article_id, case when turn=0 then 0 else conv_id*100+1 end as parent_id,
  case when turn=0 then 0 else conv_id*100+turn end as reply_to_comment_id, (conv_id*31+turn*17)%150+1 as user_id,
  case when turn=0 then 0 else (conv_id*31+(turn-1)*17)%150+1 end as reply_to_user_id, text as content,
  case when (conv_id+turn)%7=6 then 'pending' when (conv_id+turn)%11=10 then 'rejected' else 'approved' end as status,
  concat('10.0.0.', cast(conv_id%40 as string)) as ip, timestamp '2024-01-01 00:00:00' + interval '1' minute * (conv_id*13+turn) as create_time from conversations""",
    "comment_report": """select min(event_id)+1 as id, (event_id%10)*100+1 as comment_id, user_id+1 as reporter_id,
  case when min(event_id)%5=0 then 'accepted' else 'pending' end as status,
  timestamp '2024-02-01 00:00:00' + interval '1' second * min(event_id) as create_time
  from events where event_type='error' group by (event_id%10)*100+1, user_id+1""",
    "article_image": """select page_id+1 as id, concat('img/', cast(page_id as string), '.png') as object_key,
  concat('https://img.example.com/base/', cast(page_id as string), '.png') as url, case when page_id%3=0 then 'unused' else 'used' end as status,
  length(html) as size, timestamp '2024-01-01 00:00:00' + interval '1' minute * (page_id%37) as update_time from pages""",
    "image_reference": """select event_id+1 as id, event_id%97+1 as image_id, event_id%193+1 as article_id,
  case when event_id%2=0 then 'markdown' else 'html' end as ref_type, 1+event_id%3 as ref_count,
  timestamp '2024-01-01 00:00:00' + interval '1' second * event_id as create_time from events""",
    "article_md": """select doc_id+1 as article_id, concat('intro ![a](https://img.example.com/base/', cast(doc_id%50 as string),
  '.png) mid ![b](<https://IMG.example.com/base/x%20y.png>) ![a](https://img.example.com/base/', cast(doc_id%50 as string),
  '.png "t") ![d](data:image/png;base64,AA) ![o](https://other.example.org/z.png)') as content from documents""",
    "site_dynamic": """select n_nationkey+1 as id, n_name as content, case when n_nationkey%4=0 then 'hidden' else 'published' end as status,
  n_nationkey%6 as sort_order, timestamp '2024-01-01 00:00:00' + interval '1' day * (n_nationkey%5) as event_time from nation""",
    "link": """select s_suppkey+1 as id, s_name as name, concat('https://', s_name, '.example.com') as url,
  timestamp '2024-01-01 00:00:00' + interval '1' hour * (s_suppkey%7) as update_time from supplier""",
    "view_event": "select event_id, event_id%250+1 as article_id, user_id, ts from events where event_type='view'",
    "comment_in": """select event_id+1 as comment_id, user_id%20 as user_id, event_id%5 as article_id, concat('10.0.0.', cast(user_id%8 as string)) as ip,
  concat('Note on topic ', event_type, ' with payload ', props) as content, 1704067200 + cast(floor(event_id/3) as bigint)*40 as ts_s from events""",
    "risk_request": """select event_id+1 as request_id, case when event_id%2=0 then 'view-log' else 'share-create' end as scene,
  case when event_id%40=0 then '00000000000000000000000000000000' else cast(event_id%25 as string) end as target_id,
  cast(user_id as string) as fp, concat('10.1.0.', cast(user_id%30 as string)) as ip,
  case event_id%6 when 0 then 'Mozilla/5.0 Chrome/120.0' when 1 then 'curl/8.0' when 2 then '' when 3 then 'Mozilla/5.0 Firefox/121.0' when 4 then 'Googlebot/2.1' else 'CustomAgent' end as user_agent,
  case event_id%5 when 0 then '' when 1 then 'navigate' when 2 then 'cors' when 3 then 'websocket' else 'no-cors' end as sf_mode,
  case event_id%3 when 0 then 'same-origin' when 1 then '' else 'cross-site' end as sf_site, case event_id%4 when 0 then '' else 'empty' end as sf_dest,
  case event_id%7 when 0 then '' when 1 then 'fr-FR,fr;q=0.9' else 'zh-CN,zh;q=0.9,en;q=0.8' end as accept_language,
  case event_id%3 when 0 then 'zh-CN' when 1 then 'en' else '' end as lang,
  case event_id%4 when 0 then '1920x1080' when 1 then '300x400' when 2 then 'bad' else '' end as screen,
  case event_id%5 when 0 then 'prerender' when 1 then 'navigate' else '' end as perf_nav, 'https://a.example.com/' as referer,
  cast(event_id%60 as int) as sample_count, event_id%9000 as duration_ms, (event_id%11)/100.0 as speed_std, (event_id%7)/2000.0 as jerk_mean,
  event_id%3 as click_count, event_id%50 as click_dwell_ms, event_id%9 as keydown_count, event_id%60 as key_flight_ms, event_id%2 as wheel_count,
  event_id%4 as flags, 1704067200000 + event_id*700 as server_ms, 1704067200000 + event_id*700 - (event_id%13)*12000 as client_ms, event_id%50 as nonce from events""",
    "attempt": """select event_id+1 as attempt_id, cast(user_id%12 as string) as username, concat('10.2.0.', cast(user_id%9 as string)) as ip,
  event_type in ('purchase','signup') as success, 1704067200000 + event_id*2500 as ts_ms from events""",
    "signal_in": """select l_orderkey as comment_id, l_linenumber as seq, l_partkey as tie,
  case when l_tax<0.03 then 'lexicon' when l_tax<0.06 then 'context' else 'structure' end as source,
  case when l_discount<0.04 then 'abuse' when l_discount<0.08 then 'spam_fraud' else 'url' end as category,
  case when l_returnflag='R' and l_quantity<10 then 'block' when l_returnflag in ('R','A') then 'review' else 'notice' end as level,
  cast(l_quantity as int) as score from lineitem""",
    "corpus_case": """select doc_id+1 as id, case when toxic=1 then 'violation' when quality=1 then 'normal' else 'gray' end as corpus,
  case when toxic=1 then 'risk' when quality=1 then 'approved' else 'pending' end as expected,
  case when doc_id%5=0 then 'rejected' when doc_id%5=1 then 'pending' else 'approved' end as actual,
  concat('c', cast(doc_id%6 as string)) as category from labels""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a DataFrame over the driver's files."""
    text = VIEWS[name]
    used = [t for t in BASE if re.search(rf"\bfrom {t}\b", text)]
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    for t in used:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **sources) if sources else spark.sql(text)


def with_views(names: str, sql: str) -> str:
    """``sql`` after common table expressions of the named views."""
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names.split())
    return f"with {head}\n{sql}" if not sql.lstrip().startswith(",") else f"with {head}{sql}"
