"""DuckDB twins of the registered queries.

Each query is written the way the reference states it (windows, joins,
count distinct), over the same adapter views as ``feedlake.sources.fixtures``,
so a match checks our re-planned Spark form against the plain semantics.
"""

from __future__ import annotations

# --- adapter views (mirror feedlake.sources.fixtures) ------------------------
FIXTURE_SQL = {
    "interactions": """
SELECT event_id, user_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS post_id,
       CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'save'
            WHEN 'error' THEN 'comment'
            WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'share' ELSE 'follow_author' END END
         AS interaction_type,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS occurred_at_raw,
       concat_ws('_', CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d')) AS session_id,
       (['web', 'mobile', 'tablet'])[event_id % 3 + 1] AS device_type,
       (['feed', 'search', 'profile', 'recommendation'])[event_id % 4 + 1] AS source_surface,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS INTEGER) END AS dwell_time_seconds
FROM events""",
    "posts": """
SELECT d.doc_id AS post_id, d.doc_id % 150 AS author_id, split_part(d.text, chr(10), 1) AS title,
       '/posts/' || CAST(d.doc_id AS VARCHAR) AS canonical_url, d.text AS body_text,
       CAST(NULL AS VARCHAR) AS excerpt,
       '["' || d.source || '"]' AS categories, '["' || d.lang || '"]' AS tags,
       CASE WHEN d.doc_id % 13 <> 0 THEN strftime(TIMESTAMP '2024-01-01 00:00:00'
            + to_minutes(CAST(d.n_chars AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS published_at_raw,
       COALESCE(cc.n, 0) AS comments_count
FROM documents d
LEFT JOIN (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id) cc
  ON cc.conv_id = d.doc_id""",
    "comments": """
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id, conv_id AS post_id,
       (conv_id * 7 + turn) % 150 AS user_id,
       CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END
         AS parent_comment_id,
       text AS body_text,
       CASE WHEN turn <> 3 THEN strftime(TIMESTAMP '2024-01-01 00:00:00'
            + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn // 2 AS INTEGER)),
            '%Y-%m-%dT%H:%M:%S') END AS commented_at_raw
FROM conversations""",
    "post_media": """
SELECT page_id AS media_id, page_id AS post_id, 'image' AS media_type, url AS source_url,
       'images/' || CAST(page_id AS VARCHAR) || '.jpg' AS object_key, 'minio' AS storage_provider,
       1 AS display_order
FROM pages""",
    "users": """
SELECT c.c_custkey AS user_id, c.c_name AS username, c.c_mktsegment AS account_type,
       COALESCE(a.n, 0) AS authored_posts_count, COALESCE(w.n, 0) AS comments_count,
       CASE WHEN c.c_acctbal < 0 THEN '' WHEN c.c_acctbal < 100 THEN '[broken'
            ELSE '["' || lower(c.c_mktsegment) || '", "nation' || CAST(c.c_nationkey AS VARCHAR) || '"]' END
         AS interest_keywords,
       CAST(fo.first_order AS DATE) AS joined_on
FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) fo
  ON fo.o_custkey = c.c_custkey
LEFT JOIN (SELECT doc_id % 150 AS uid, CAST(count(*) AS INTEGER) AS n FROM documents GROUP BY 1) a
  ON a.uid = c.c_custkey
LEFT JOIN (SELECT (conv_id * 7 + turn) % 150 AS uid, CAST(count(*) AS INTEGER) AS n
           FROM conversations GROUP BY 1) w
  ON w.uid = c.c_custkey""",
}


def with_fixtures(body: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# --- gold features -----------------------------------------------------------
_LABEL = """CASE WHEN interaction_type = 'like' THEN CAST(2.0 AS DOUBLE)
            WHEN interaction_type = 'comment' THEN CAST(3.0 AS DOUBLE)
            WHEN interaction_type = 'save' THEN CAST(4.0 AS DOUBLE)
            WHEN interaction_type = 'share' THEN CAST(5.0 AS DOUBLE)
            WHEN interaction_type = 'follow_author' THEN CAST(5.0 AS DOUBLE)
            WHEN interaction_type = 'view' AND dwell_time_seconds >= 30 THEN CAST(1.0 AS DOUBLE)
            ELSE CAST(0.0 AS DOUBLE) END"""


def _cnt(kind: str, name: str) -> str:
    return f"CAST(sum(CASE WHEN interaction_type = '{kind}' THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


USER_AGG = f"""
SELECT user_id, count(event_id) AS total_interactions,
       {_cnt('view', 'num_views')}, {_cnt('like', 'num_likes')},
       {_cnt('comment', 'num_comments_interaction')}, {_cnt('save', 'num_saves')},
       {_cnt('share', 'num_shares')}, {_cnt('follow_author', 'num_follows')},
       avg(dwell_time_seconds) AS avg_dwell_time,
       count(DISTINCT post_id) AS num_unique_posts, count(DISTINCT session_id) AS num_sessions
FROM interactions GROUP BY user_id"""

POST_AGG = f"""
SELECT post_id, count(event_id) AS total_interactions,
       {_cnt('view', 'num_views')}, {_cnt('like', 'num_likes')},
       {_cnt('comment', 'num_post_comments')}, {_cnt('save', 'num_saves')},
       {_cnt('share', 'num_shares')},
       avg(dwell_time_seconds) AS avg_dwell_time, count(DISTINCT user_id) AS num_unique_users
FROM interactions GROUP BY post_id"""


def _mode(target: str, alias: str) -> str:
    return f"""
SELECT user_id, {target} AS {alias} FROM (
  SELECT user_id, {target}, row_number() OVER (PARTITION BY user_id
         ORDER BY count(*) DESC, {target} DESC NULLS LAST) AS rn
  FROM interactions GROUP BY user_id, {target}) WHERE rn = 1"""


POST_ENG_COLS = """pa.post_id, pa.total_interactions, pa.num_views, pa.num_likes, pa.num_post_comments,
       pa.num_saves, pa.num_shares, pa.avg_dwell_time, pa.num_unique_users,
       pa.num_likes / greatest(pa.num_views, 1) AS like_rate,
       pa.num_post_comments / greatest(pa.num_views, 1) AS comment_rate"""

USER_FEATURES = f"""
WITH ua AS ({USER_AGG}), pd AS ({_mode('device_type', 'preferred_device')}),
     ps AS ({_mode('source_surface', 'preferred_surface')})
SELECT u.user_id, u.username, u.account_type, u.authored_posts_count, u.comments_count,
       u.interest_keywords, u.joined_on,
       array_to_string(CASE WHEN json_valid(u.interest_keywords) AND json_type(u.interest_keywords) = 'ARRAY'
                            THEN json_transform(u.interest_keywords, '["VARCHAR"]') ELSE [] END, ', ')
         AS interest_kw_text,
       array_to_string(CASE WHEN json_valid(u.interest_keywords) AND json_type(u.interest_keywords) = 'ARRAY'
                            THEN json_transform(u.interest_keywords, '["VARCHAR"]') ELSE [] END, '|')
         AS interest_kw_list,
       CAST(datediff('day', u.joined_on, DATE '2026-05-18') AS INTEGER) AS tenure_days,
       COALESCE(ua.total_interactions, 0) AS total_interactions, ua.num_views, ua.num_likes,
       ua.num_comments_interaction, ua.num_saves, ua.num_shares, ua.num_follows,
       COALESCE(ua.avg_dwell_time, 0) AS avg_dwell_time, ua.num_unique_posts, ua.num_sessions,
       pd.preferred_device, ps.preferred_surface
FROM users u LEFT JOIN ua USING (user_id) LEFT JOIN pd USING (user_id) LEFT JOIN ps USING (user_id)"""

POST_FEATURES = f"""
WITH pa AS ({POST_AGG}), img AS (SELECT post_id, object_key FROM (
       SELECT post_id, object_key, row_number() OVER (PARTITION BY post_id ORDER BY object_key DESC) AS rn
       FROM post_media) WHERE rn = 1)
SELECT p.post_id, p.author_id, p.title, p.canonical_url, p.body_text, p.excerpt, p.categories, p.tags,
       array_to_string(json_transform(p.categories, '["VARCHAR"]'), '|') AS categories_list,
       array_to_string(json_transform(p.tags, '["VARCHAR"]'), '|') AS tags_list,
       p.published_at_raw, p.comments_count,
       CASE WHEN p.body_text IS NOT NULL THEN CAST(len(string_split(p.body_text, ' ')) AS INTEGER) END AS body_word_count,
       {POST_ENG_COLS.replace('pa.post_id, ', '')},
       img.object_key, img.object_key IS NOT NULL AS has_image
FROM posts p LEFT JOIN pa USING (post_id) LEFT JOIN img USING (post_id)"""

INTERACTION_LABELS = f"""
WITH i AS (SELECT *, TRY_CAST(occurred_at_raw AS TIMESTAMP) AS occurred_at, {_LABEL} AS label
           FROM interactions),
latest AS (SELECT * FROM (SELECT user_id, post_id, event_id, interaction_type,
                  CAST(hour(occurred_at) AS INTEGER) AS hour_of_day, CAST(dayofweek(occurred_at) AS INTEGER) AS day_of_week,
                  device_type, source_surface, occurred_at,
                  row_number() OVER (PARTITION BY user_id, post_id
                                     ORDER BY occurred_at DESC NULLS LAST, event_id DESC) AS rn
                  FROM i) WHERE rn = 1),
ml AS (SELECT user_id, post_id, max(label) AS label FROM i GROUP BY user_id, post_id)
SELECT ml.user_id, ml.post_id, ml.label, latest.event_id, latest.interaction_type, latest.hour_of_day,
       latest.day_of_week, latest.device_type, latest.source_surface, latest.occurred_at
FROM ml JOIN latest ON ml.user_id = latest.user_id AND ml.post_id = latest.post_id"""

TRAINING_PAIRS = f"""
WITH uf AS ({USER_FEATURES}), pf AS ({POST_FEATURES}), il AS ({INTERACTION_LABELS})
SELECT il.*,
       uf.account_type, uf.tenure_days, uf.authored_posts_count, uf.comments_count AS user_comments_count,
       uf.total_interactions AS user_total_interactions, uf.num_views AS user_num_views,
       uf.num_likes AS user_num_likes, uf.num_comments_interaction, uf.num_saves, uf.num_shares,
       uf.num_follows, uf.avg_dwell_time AS user_avg_dwell_time, uf.num_unique_posts, uf.num_sessions,
       uf.preferred_device, uf.preferred_surface,
       pf.author_id, pf.body_word_count, pf.comments_count AS post_comments_count,
       pf.total_interactions AS post_total_interactions, pf.num_views AS post_num_views,
       pf.num_likes AS post_num_likes, pf.avg_dwell_time AS post_avg_dwell_time, pf.num_unique_users,
       pf.like_rate, pf.comment_rate, pf.has_image
FROM il LEFT JOIN uf ON il.user_id = uf.user_id LEFT JOIN pf ON il.post_id = pf.post_id"""

ALL_FIXTURES = ("interactions", "posts", "comments", "post_media", "users")

SQL: dict[str, str] = {
    "user_engagement": with_fixtures(f"""
SELECT user_id, total_interactions, num_views, num_likes, num_comments_interaction, num_saves, num_shares,
       num_follows, avg_dwell_time, num_unique_posts, num_sessions FROM ({USER_AGG})""", "interactions"),
    "post_engagement": with_fixtures(f"WITH pa AS ({POST_AGG}) SELECT {POST_ENG_COLS} FROM pa",
                                     "interactions"),
    "preferred_device": with_fixtures(_mode("device_type", "preferred_device"), "interactions"),
    "preferred_surface": with_fixtures(_mode("source_surface", "preferred_surface"), "interactions"),
    "user_features": with_fixtures(USER_FEATURES, "interactions", "users"),
    "post_features": with_fixtures(POST_FEATURES, "interactions", "posts", "post_media"),
    "interaction_labels": with_fixtures(INTERACTION_LABELS, "interactions"),
    "training_pairs": with_fixtures(TRAINING_PAIRS, "interactions", "users", "posts", "post_media"),
}

# --- staging -------------------------------------------------------------------
STAGING_USERS = """
SELECT CAST(user_id AS VARCHAR) AS user_id, username,
       CASE WHEN authored_posts_count > 0 AND comments_count > 0 THEN 'both'
            WHEN authored_posts_count > 0 THEN 'author' ELSE '' END AS user_type,
       CAST(authored_posts_count AS VARCHAR) AS num_posts, CAST(comments_count AS VARCHAR) AS num_comments,
       COALESCE(interest_keywords, '') AS interests, COALESCE(CAST(joined_on AS VARCHAR), '') AS created_at
FROM users"""

STAGING_POSTS = """
SELECT CAST(p.post_id AS VARCHAR) AS post_id, p.title, CAST(p.author_id AS VARCHAR) AS author_id,
       COALESCE(p.canonical_url, '') AS url, COALESCE(p.body_text, '') AS content, COALESCE(p.excerpt, '') AS excerpt,
       COALESCE(p.categories, '') AS categories, COALESCE(p.tags, '') AS tags,
       COALESCE(p.published_at_raw, '') AS published_at, CAST(p.comments_count AS VARCHAR) AS comments_count,
       COALESCE(m.source_url, '') AS image_url, COALESCE(m.object_key, '') AS image_path
FROM posts p LEFT JOIN post_media m ON m.post_id = p.post_id"""

_MEDIA_KEY = "md5(length(post_id) || ':' || post_id || image_path)"

DQ = """
SELECT 'primary_key' AS "check", 'users' AS table_name, CAST(user_id AS VARCHAR) AS key, count(*) AS n_rows
  FROM users GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'unique(username)', 'users', username, count(*) FROM users WHERE username IS NOT NULL GROUP BY username HAVING count(*) > 1
UNION ALL SELECT 'primary_key', 'posts', CAST(post_id AS VARCHAR), count(*) FROM posts GROUP BY post_id
  HAVING count(*) > 1
UNION ALL SELECT 'primary_key', 'post_media', CAST(media_id AS VARCHAR), count(*) FROM post_media
  GROUP BY media_id HAVING count(*) > 1
UNION ALL SELECT 'unique(post_id,object_key)', 'post_media', concat_ws('|', post_id, object_key), count(*)
  FROM post_media WHERE post_id IS NOT NULL AND object_key IS NOT NULL GROUP BY post_id, object_key HAVING count(*) > 1
UNION ALL SELECT 'primary_key', 'comments', comment_id, count(*) FROM comments GROUP BY comment_id
  HAVING count(*) > 1
UNION ALL SELECT 'primary_key', 'interactions', CAST(event_id AS VARCHAR), count(*) FROM interactions
  GROUP BY event_id HAVING count(*) > 1
UNION ALL SELECT 'unique_like', 'interactions', concat_ws('|', user_id, post_id, interaction_type), count(*)
  FROM interactions WHERE interaction_type = 'like' AND user_id IS NOT NULL AND post_id IS NOT NULL
  GROUP BY user_id, post_id, interaction_type
  HAVING count(*) > 1
UNION ALL SELECT 'fk(author_id->users.user_id)', 'posts', CAST(author_id AS VARCHAR), count(*) FROM posts
  WHERE author_id IS NOT NULL AND author_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL)
  GROUP BY author_id
UNION ALL SELECT 'fk(post_id->posts.post_id)', 'post_media', CAST(post_id AS VARCHAR), count(*) FROM post_media
  WHERE post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM posts WHERE post_id IS NOT NULL)
  GROUP BY post_id
UNION ALL SELECT 'fk(post_id->posts.post_id)', 'comments', CAST(post_id AS VARCHAR), count(*) FROM comments
  WHERE post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM posts WHERE post_id IS NOT NULL)
  GROUP BY post_id
UNION ALL SELECT 'fk(user_id->users.user_id)', 'comments', CAST(user_id AS VARCHAR), count(*) FROM comments
  WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL)
  GROUP BY user_id
UNION ALL SELECT 'fk(user_id->users.user_id)', 'interactions', CAST(user_id AS VARCHAR), count(*)
  FROM interactions
  WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM users WHERE user_id IS NOT NULL)
  GROUP BY user_id
UNION ALL SELECT 'fk(post_id->posts.post_id)', 'interactions', CAST(post_id AS VARCHAR), count(*)
  FROM interactions
  WHERE post_id IS NOT NULL AND post_id NOT IN (SELECT post_id FROM posts WHERE post_id IS NOT NULL)
  GROUP BY post_id
UNION ALL SELECT 'check(interaction_type)', 'interactions', interaction_type, count(*) FROM interactions
  WHERE interaction_type IS NOT NULL
    AND interaction_type NOT IN ('view', 'like', 'save', 'share', 'comment', 'follow_author')
  GROUP BY interaction_type
UNION ALL SELECT 'not_null', t, c, n FROM (
  SELECT 'users' AS t, 'user_id' AS c, count(*) FILTER (WHERE user_id IS NULL) AS n FROM users
  UNION ALL SELECT 'users', 'username', count(*) FILTER (WHERE username IS NULL) FROM users
  UNION ALL SELECT 'posts', 'post_id', count(*) FILTER (WHERE post_id IS NULL) FROM posts
  UNION ALL SELECT 'posts', 'author_id', count(*) FILTER (WHERE author_id IS NULL) FROM posts
  UNION ALL SELECT 'posts', 'title', count(*) FILTER (WHERE title IS NULL) FROM posts
  UNION ALL SELECT 'comments', 'comment_id', count(*) FILTER (WHERE comment_id IS NULL) FROM comments
  UNION ALL SELECT 'comments', 'post_id', count(*) FILTER (WHERE post_id IS NULL) FROM comments
  UNION ALL SELECT 'comments', 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM comments
  UNION ALL SELECT 'interactions', 'event_id', count(*) FILTER (WHERE event_id IS NULL) FROM interactions
  UNION ALL SELECT 'interactions', 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM interactions
  UNION ALL SELECT 'interactions', 'post_id', count(*) FILTER (WHERE post_id IS NULL) FROM interactions
  UNION ALL SELECT 'interactions', 'interaction_type', count(*) FILTER (WHERE interaction_type IS NULL)
    FROM interactions) WHERE n > 0"""

SQL.update({
    "staging_clean_users": with_fixtures(f"""
SELECT user_id, username, COALESCE(NULLIF(user_type, ''), 'commenter') AS account_type,
       COALESCE(TRY_CAST(NULLIF(num_posts, '') AS INTEGER), 0) AS authored_posts_count,
       COALESCE(TRY_CAST(NULLIF(num_comments, '') AS INTEGER), 0) AS comments_count,
       NULLIF(interests, '') AS interest_keywords, TRY_CAST(NULLIF(created_at, '') AS DATE) AS joined_on
FROM ({STAGING_USERS}) su
WHERE NULLIF(user_id, '') IS NOT NULL AND NULLIF(username, '') IS NOT NULL""", "users"),
    "staging_clean_posts": with_fixtures(f"""
SELECT post_id, author_id, COALESCE(NULLIF(title, ''), '(untitled post)') AS title,
       NULLIF(url, '') AS canonical_url, NULLIF(content, '') AS body_text, NULLIF(excerpt, '') AS excerpt, NULLIF(categories, '') AS categories,
       NULLIF(tags, '') AS tags, NULLIF(published_at, '') AS published_at_raw,
       COALESCE(TRY_CAST(NULLIF(comments_count, '') AS INTEGER), 0) AS comments_count
FROM ({STAGING_POSTS}) sp
WHERE NULLIF(post_id, '') IS NOT NULL AND NULLIF(author_id, '') IS NOT NULL""", "posts", "post_media"),
    "staging_clean_comments": with_fixtures("""
SELECT comment_id, CAST(post_id AS VARCHAR) AS post_id, CAST(user_id AS VARCHAR) AS user_id,
       parent_comment_id, NULLIF(body_text, '') AS body_text, commented_at_raw
FROM comments""", "comments"),
    "staging_clean_interactions": with_fixtures("""
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
       CAST(post_id AS VARCHAR) AS post_id, interaction_type, occurred_at_raw, session_id, device_type,
       source_surface, dwell_time_seconds
FROM interactions""", "interactions"),
    "staging_post_media": with_fixtures(f"""
SELECT {_MEDIA_KEY} AS media_id, post_id, 'image' AS media_type, NULLIF(image_url, '') AS source_url,
       image_path AS object_key, 'minio' AS storage_provider, 1 AS display_order
FROM ({STAGING_POSTS}) sp
WHERE NULLIF(post_id, '') IS NOT NULL AND NULLIF(image_path, '') IS NOT NULL""", "posts", "post_media"),
    "dq_violations": with_fixtures(DQ, *ALL_FIXTURES),
})

# --- CDC ---------------------------------------------------------------------
ORDER_EVENTS = """
o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st,
             CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END AS new_st, o_totalprice,
             strftime(o_orderdate, '%Y-%m-%d') AS od, o_orderpriority, epoch_ms(o_orderdate) AS ts0 FROM orders),
ev AS (SELECT k, 0 AS step, 'r' AS op, st AS status FROM o
       UNION ALL SELECT k, 1, 'u', new_st FROM o WHERE k % 5 = 0
       UNION ALL SELECT k, 2, 'd', CASE WHEN k % 5 = 0 THEN new_st ELSE st END FROM o WHERE k % 11 = 0)"""


def _normalized(topic: str) -> str:
    return f"""
SELECT ev.op, epoch_ms(o.ts0 + ev.step * 1000) AS event_ts, o.ts0 + ev.step * 1000 AS event_ts_ms,
       o.ts0 + ev.step * 1000 AS source_ts_ms, 'public' AS schema_name, 'orders' AS table_name,
       '{topic}' AS topic_name, '2024-06-01' AS object_date, lpad(CAST(o.k % 24 AS VARCHAR), 2, '0') AS object_hour,
       ev.op = 'd' AS is_delete, o.k AS o_orderkey, ev.status AS o_orderstatus, o.o_custkey, o.o_totalprice,
       o.od AS o_orderdate, o.o_orderpriority
FROM ev JOIN o ON ev.k = o.k"""


SQL.update({
    "cdc_normalize": f"WITH {ORDER_EVENTS}\n{_normalized('postgres.public.orders')}",
    "cdc_current_state": """
WITH s AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS step FROM orders)
SELECT o_orderkey, o_custkey,
       CASE WHEN step = 1 THEN (CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END) ELSE o_orderstatus END
         AS o_orderstatus,
       o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
       CASE WHEN step = 1 THEN 'u' ELSE 'r' END AS op,
       epoch_ms(epoch_ms(o_orderdate) + step * 1000) AS event_ts, epoch_ms(o_orderdate) + step * 1000 AS event_ts_ms,
       epoch_ms(o_orderdate) + step * 1000 AS source_ts_ms, 'public' AS schema_name, 'orders' AS table_name,
       'feedlake_cdc_public_orders' AS topic_name, '2024-06-01' AS object_date,
       lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS object_hour, false AS is_delete
FROM s WHERE o_orderkey % 11 <> 0""",
    "cdc_event_union": with_fixtures(f"""WITH {ORDER_EVENTS}
SELECT * EXCLUDE (o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderdate, o_orderpriority), o_orderkey AS row_key FROM ({_normalized('postgres.public.orders')})
UNION ALL
SELECT 'c' AS op, epoch_ms(t) AS event_ts, t AS event_ts_ms, t AS source_ts_ms, 'public' AS schema_name,
       'interactions' AS table_name, 'postgres.public.interactions' AS topic_name, '2024-06-01' AS object_date,
       lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') AS object_hour, false AS is_delete, event_id AS row_key
FROM (SELECT event_id, (epoch_us(TRY_CAST(occurred_at_raw AS TIMESTAMP)) // 1000) AS t FROM interactions)""",
                                     "interactions"),
})

# --- feed --------------------------------------------------------------------
FEED_PAGE = """
SELECT *, 10 + count(*) OVER () AS next_offset, count(*) OVER () = 20 AS has_more FROM (
SELECT p.post_id, p.title, COALESCE(p.body_text, '') AS body_text, COALESCE(p.excerpt, '') AS excerpt,
       COALESCE(p.tags, '') AS tags, COALESCE(p.categories, '') AS categories,
       COALESCE(p.published_at_raw, '') AS published_at, COALESCE(p.canonical_url, '') AS canonical_url,
       u.user_id AS author_id, u.username AS author_username,
       CASE WHEN pm.object_key IS NOT NULL AND pm.object_key <> '' THEN '/media/' || pm.object_key ELSE '' END
         AS image_url,
       COALESCE(cs.comment_count, 0) AS comment_count, COALESCE(ls.like_count, 0) AS like_count,
       EXISTS (SELECT 1 FROM interactions i WHERE i.post_id = p.post_id AND i.user_id = 7
               AND i.interaction_type = 'like') AS viewer_has_liked
FROM posts p
JOIN users u ON u.user_id = p.author_id
LEFT JOIN post_media pm ON pm.post_id = p.post_id AND pm.display_order = 1
LEFT JOIN (SELECT post_id, count(*) AS comment_count FROM comments GROUP BY post_id) cs ON cs.post_id = p.post_id
LEFT JOIN (SELECT post_id, count(*) AS like_count FROM interactions WHERE interaction_type = 'like'
           GROUP BY post_id) ls ON ls.post_id = p.post_id
ORDER BY p.published_at_raw DESC NULLS LAST, p.post_id DESC
OFFSET 10 LIMIT 20)"""


def _newest(n: int) -> str:
    return f"""
SELECT * FROM (
  SELECT c.post_id, c.comment_id, c.user_id, u.username, COALESCE(c.body_text, '') AS body_text,
         COALESCE(c.commented_at_raw, '') AS commented_at,
         row_number() OVER (PARTITION BY c.post_id ORDER BY c.commented_at_raw DESC NULLS LAST,
                            c.comment_id DESC) AS rank
  FROM comments c JOIN users u ON u.user_id = c.user_id) WHERE rank <= {n}"""


_PT = """pt AS (SELECT DISTINCT post_id, unnest(regexp_extract_all(lower(COALESCE(tags, '') || ' '
              || COALESCE(categories, '')), '[a-zA-Z0-9_+#.-]{3,}')) AS tag FROM posts)"""
_PROFILE = f"""{_PT},
sig AS (SELECT user_id, post_id, 5 AS w FROM comments
        UNION ALL SELECT user_id, post_id, CASE interaction_type WHEN 'like' THEN 2 WHEN 'save' THEN 3
                                             WHEN 'share' THEN 4 WHEN 'comment' THEN 5 END
        FROM interactions WHERE interaction_type IN ('like', 'save', 'share', 'comment')),
prof AS (SELECT s.user_id, pt.tag, CAST(sum(s.w) AS BIGINT) AS score FROM sig s JOIN pt ON pt.post_id = s.post_id
         GROUP BY s.user_id, pt.tag)"""

_SEGS = """
cp AS (SELECT DISTINCT user_id, post_id FROM comments),
segs AS (SELECT author_id AS user_id, 0 AS seg, post_id, tags AS txt FROM posts
         UNION ALL SELECT author_id, 1, post_id, categories FROM posts
         UNION ALL SELECT cp.user_id, 2, p.post_id, p.tags FROM cp JOIN posts p ON p.post_id = cp.post_id
         UNION ALL SELECT cp.user_id, 3, p.post_id, p.categories FROM cp JOIN posts p ON p.post_id = cp.post_id),
ex AS (SELECT user_id, seg, post_id, regexp_extract_all(lower(txt), '[a-zA-Z0-9_+#.-]{3,}') AS ws FROM segs),
words AS (SELECT user_id, seg, post_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ex),
firsts AS (SELECT user_id, word, seg, post_id, pos FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, word ORDER BY seg, post_id, pos) AS r FROM words)
           WHERE r = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seg, post_id, pos) AS rn
                       FROM firsts) WHERE rn <= 10),
people AS (SELECT author_id AS user_id FROM posts UNION SELECT user_id FROM comments)"""

SQL.update({
    "feed_page": with_fixtures(FEED_PAGE, *ALL_FIXTURES),
    "top_comments": with_fixtures(_newest(3), "comments", "users"),
    "post_comments": with_fixtures(_newest(50), "comments", "users"),
    "user_dimension": with_fixtures("""
WITH a AS (SELECT author_id AS user_id, count(*) AS num_posts FROM posts GROUP BY 1),
     w AS (SELECT user_id, count(*) AS num_comments FROM comments GROUP BY 1)
SELECT COALESCE(a.user_id, w.user_id) AS user_id, COALESCE(num_posts, 0) AS num_posts,
       COALESCE(num_comments, 0) AS num_comments,
       CASE WHEN COALESCE(num_posts, 0) > 0 AND COALESCE(num_comments, 0) > 0 THEN 'both'
            WHEN COALESCE(num_posts, 0) > 0 THEN 'author' ELSE 'commenter' END AS user_type
FROM a FULL OUTER JOIN w ON a.user_id = w.user_id
WHERE COALESCE(a.user_id, w.user_id) IS NOT NULL""", "posts", "comments"),
    "interest_profile": with_fixtures(f"WITH {_PROFILE}\nSELECT * FROM prof", "posts", "comments", "interactions"),
    "interest_match": with_fixtures(f"""
WITH {_PROFILE},
pairs AS (SELECT DISTINCT user_id, post_id FROM interactions WHERE user_id IS NOT NULL AND post_id IS NOT NULL),
tot AS (SELECT user_id, sum(score) AS total FROM prof GROUP BY user_id),
m AS (SELECT p.user_id, p.post_id, sum(pr.score) AS s FROM pairs p JOIN pt ON pt.post_id = p.post_id
      JOIN prof pr ON pr.user_id = p.user_id AND pr.tag = pt.tag GROUP BY p.user_id, p.post_id)
SELECT pairs.user_id, pairs.post_id,
       COALESCE(least(m.s / greatest(tot.total, 1), 1.0), 0.0) AS interest_score,
       least(po.comments_count / 50.0, 1.0) AS post_popularity
FROM pairs LEFT JOIN m ON m.user_id = pairs.user_id AND m.post_id = pairs.post_id
LEFT JOIN tot ON tot.user_id = pairs.user_id LEFT JOIN posts po ON po.post_id = pairs.post_id""",
                                    "posts", "comments", "interactions"),
    "interest_keywords": with_fixtures(f"""
WITH {_SEGS}
SELECT people.user_id, COALESCE('[' || string_agg('"' || top.word || '"', ', ' ORDER BY top.rn) || ']', '[]')
         AS interests
FROM people LEFT JOIN top ON top.user_id = people.user_id
WHERE people.user_id IS NOT NULL
GROUP BY people.user_id""", "posts", "comments"),
    "hashed_ids": with_fixtures("""
SELECT user_id, 'user_' || substring(md5(username), 1, 12) AS seed_user_id,
       'user_' || substring(md5(lower(regexp_replace(username, '^\\s+|\\s+$', '', 'g'))), 1, 12) AS web_user_id,
       lower(username) = lower(upper(username)) AS name_matches_upper
FROM users""", "users"),
    "tag_display": with_fixtures("""
SELECT post_id, array_to_string(list_concat(
         CASE WHEN tags IS NULL OR tags = '' THEN [] ELSE list_filter(list_transform(
              string_split_regex(tags, '[,|\\s]+'), lambda s: trim(s)), lambda s: length(s) > 2)[1:8] END,
         CASE WHEN categories IS NULL OR categories = '' THEN [] ELSE list_filter(list_transform(
              string_split_regex(categories, '[,|\\s]+'), lambda s: trim(s)), lambda s: length(s) > 2)[1:8] END
       )[1:8], ' ') AS display_tags
FROM posts""", "posts"),
    "list_parse": with_fixtures("""
SELECT user_id, array_to_string(kw, ', ') AS kw_text, CAST(len(kw) AS INTEGER) AS kw_count FROM (
  SELECT user_id, CASE WHEN json_valid(interest_keywords) AND json_type(interest_keywords) = 'ARRAY'
                       THEN json_transform(interest_keywords, '["VARCHAR"]') ELSE [] END AS kw FROM users)""",
                                "users"),
})

# --- streaming: the final state equals a batch computation over the same feed --------
_SI = """si AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
              CASE WHEN event_id % 97 <> 0 THEN CAST(post_id AS VARCHAR) END AS post_id,
              (epoch_us(TRY_CAST(occurred_at_raw AS TIMESTAMP)) // 1000) AS ts_ms FROM interactions)"""
_TREND = "SELECT post_id, CAST(count(*) AS DOUBLE) AS score FROM si WHERE post_id IS NOT NULL GROUP BY post_id"
_VIEWS = """SELECT user_id, post_id, pos FROM (
  SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, post_id DESC) - 1 AS pos
  FROM si WHERE post_id IS NOT NULL) WHERE pos < 100"""
_META_FIELDS = [("post_id", "CAST(post_id AS VARCHAR)"), ("author_id", "CAST(author_id AS VARCHAR)"),
                ("title", "COALESCE(title, '')"), ("canonical_url", "COALESCE(canonical_url, '')"),
                ("body_text", "COALESCE(body_text, '')"), ("excerpt", "COALESCE(excerpt, '')"),
                ("categories", "COALESCE(categories, '')"), ("tags", "COALESCE(tags, '')"),
                ("published_at_raw", "COALESCE(published_at_raw, '')"),
                ("comments_count", "CAST(comments_count AS VARCHAR)")]
_META = "\nUNION ALL ".join(
    f"SELECT CAST(post_id AS VARCHAR) AS post_id, '{f}' AS field, {e} AS value FROM posts" for f, e in _META_FIELDS)
_SCORES = """SELECT CAST(post_id AS VARCHAR) AS post_id, CAST(score AS DOUBLE) AS score FROM (
  SELECT post_id, CASE WHEN post_id % 7 <> 0 AND pub IS NOT NULL THEN pub
                       WHEN post_id % 26 <> 0 THEN 1700000000000 + post_id END AS score
  FROM (SELECT post_id, epoch_ms(CAST(published_at_raw AS TIMESTAMP)) AS pub FROM posts)) WHERE score IS NOT NULL"""
_OUTCOMES = """SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 97 <> 0 THEN 'INTERACTION' ELSE 'IGNORED' END AS outcome FROM interactions
  UNION ALL SELECT CASE WHEN (post_id % 7 <> 0 AND published_at_raw IS NOT NULL) OR post_id % 26 <> 0
                        THEN 'POST_WITH_SCORE' ELSE 'POST_WITHOUT_SCORE' END FROM posts
  UNION ALL SELECT 'IGNORED' FROM orders
  UNION ALL SELECT 'IGNORED' FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT 'IGNORED' FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT 'MALFORMED' FROM pages) GROUP BY outcome"""
_LANDED = f"""WITH {ORDER_EVENTS},
p AS (SELECT post_id, title, CASE WHEN post_id % 7 <> 0 THEN epoch_ms(CAST(published_at_raw AS TIMESTAMP)) END AS ts,
             CASE WHEN post_id % 26 <> 0 THEN 1700000000000 + post_id END AS src FROM posts),
r AS (SELECT 'interactions' AS tbl, 'c' AS op, (epoch_us(TRY_CAST(occurred_at_raw AS TIMESTAMP)) // 1000) AS ts,
             (epoch_us(TRY_CAST(occurred_at_raw AS TIMESTAMP)) // 1000) AS src, NULL AS bk, event_id AS ak,
             CAST(NULL AS VARCHAR) AS title FROM interactions
      UNION ALL SELECT 'posts', 'c', ts, src, NULL, post_id, title FROM p
      UNION ALL SELECT 'orders', ev.op, o.ts0 + ev.step * 1000, o.ts0 + ev.step * 1000,
                       CASE WHEN ev.op <> 'r' THEN ev.k END, CASE WHEN ev.op <> 'd' THEN ev.k END, NULL
                FROM ev JOIN o ON ev.k = o.k)
SELECT 'feedlake_cdc_public_' || tbl AS topic, 0 AS partition, CAST(NULL AS BIGINT) AS "offset",
       COALESCE(ts, src) AS kafka_timestamp, tbl AS "table", 'public' AS schema, op, ts AS event_ts_ms,
       CAST(NULL AS BIGINT) AS event_ts_us, CAST(NULL AS BIGINT) AS event_ts_ns, src AS source_ts_ms,
       CAST(NULL AS VARCHAR) AS snapshot, CAST(NULL AS BIGINT) AS tx_id, CAST(NULL AS BIGINT) AS lsn,
       CAST(bk AS VARCHAR) AS before_key, CAST(ak AS VARCHAR) AS after_key, title AS after_title
FROM r"""

SQL.update({
    "trending_state": with_fixtures(f"WITH {_SI}\n{_TREND}", "interactions"),
    "trending_topn": with_fixtures(f"WITH {_SI}\n{_TREND} ORDER BY score DESC, post_id DESC LIMIT 11",
                                   "interactions"),
    "recent_views": with_fixtures(f"WITH {_SI}\n{_VIEWS}", "interactions"),
    "recent_views_read": with_fixtures(f"WITH {_SI}\nSELECT * FROM ({_VIEWS}) WHERE pos < 11", "interactions"),
    "coldstart_meta": with_fixtures(_META, "posts"),
    "coldstart_scores": with_fixtures(_SCORES, "posts"),
    "event_outcomes": with_fixtures(_OUTCOMES, "interactions", "posts"),
    "raw_landing": with_fixtures(_LANDED, "interactions", "posts"),
})

# --- vectors -----------------------------------------------------------------
_F4 = """CASE WHEN {c} IS NULL OR {c} = '' THEN []
            WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN json_transform({c}, '["VARCHAR"]')
            ELSE list_filter(list_transform(string_split(trim({c}, '[]'), ''' '''), lambda s: trim(s, ''' "''')),
                             lambda s: s <> '') END"""
_NORM = "sqrt(list_reduce(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b))"
_SUMMARY = ("CAST(len({v}) AS INTEGER) AS {p}_dim, " + _NORM.format(v="{v}") + " AS {p}_norm, "
            "list_reduce(list_transform({v}, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) AS {p}_sum, "
            "CAST({v}[1] AS DOUBLE) AS {p}_first")
_UNIT = ("list_transform({v}, lambda x: CAST(CASE WHEN " + _NORM.format(v="{v}") +
         " > 0 THEN CAST(x AS DOUBLE) / " + _NORM.format(v="{v}") + " ELSE 0.0 END AS FLOAT))")

SQL.update({
    "user_text": with_fixtures("""
SELECT CAST(user_id AS VARCHAR) AS user_id,
       array_to_string(CASE WHEN json_valid(interest_keywords) AND json_type(interest_keywords) = 'ARRAY'
                            THEN json_transform(interest_keywords, '["VARCHAR"]') ELSE [] END, ' ') AS text
FROM users""", "users"),
    "post_text": with_fixtures(f"""
SELECT CAST(post_id AS VARCHAR) AS post_id,
       concat_ws(' ', COALESCE(title, ''), substring(COALESCE(body_text, ''), 1, 512),
                 array_to_string({_F4.format(c='tags')}, ' '), array_to_string({_F4.format(c='categories')}, ' '))
         AS text
FROM posts""", "posts"),
    "l2_normalize": f"""
SELECT id, label, norm, {_SUMMARY.format(v='unit', p='unit')} FROM (
SELECT CAST(vec_id AS VARCHAR) AS id, label, {_NORM.format(v='embedding')} AS norm,
       {_UNIT.format(v='embedding')} AS unit
FROM embeddings)""",
    "embedding_mapping": with_fixtures(f"""
WITH img AS (SELECT post_id, max(object_key) AS object_key FROM post_media GROUP BY post_id),
pm AS (SELECT p.post_id, img.object_key IS NOT NULL AS has_image, e.embedding AS emb
       FROM posts p LEFT JOIN img ON img.post_id = p.post_id
       LEFT JOIN post_media m ON m.post_id = img.post_id AND m.object_key = img.object_key
       LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = CAST(m.media_id AS VARCHAR))
SELECT post_id, has_image, {_SUMMARY.format(v='image_embedding', p='image')} FROM (
SELECT CAST(post_id AS VARCHAR) AS post_id, has_image,
       CASE WHEN has_image AND emb IS NOT NULL THEN {_UNIT.format(v='emb')}
            ELSE list_transform(range(64), lambda i: CAST(0.0 AS FLOAT)) END AS image_embedding
FROM pm)""", "posts", "post_media"),
})

# --- raw posts and comment extraction --------------------------------------------
_RAW = """
th AS (SELECT c0.conv_id, c0.turn AS t, c0.text AS x0, c1.text AS x1, c2.text AS x2
       FROM conversations c0
       LEFT JOIN conversations c1 ON c1.conv_id = c0.conv_id AND c1.turn = c0.turn + 1
       LEFT JOIN conversations c2 ON c2.conv_id = c0.conv_id AND c2.turn = c0.turn + 2
       WHERE c0.turn % 3 = 0),
raw AS (SELECT th.*, th.t // 3 AS thread, CAST(th.conv_id AS VARCHAR) || '_' || CAST(th.t // 3 AS VARCHAR) AS idx,
               COALESCE(split_part(d.text, chr(10), 1), 'untitled') || ' #' || CAST(th.t // 3 AS VARCHAR) AS title,
               pg.url, d.text AS content, d.source, d.lang,
               (th.conv_id + th.t // 3) % 2 = 0 AS is_json
        FROM th LEFT JOIN documents d ON d.doc_id = th.conv_id LEFT JOIN pages pg ON pg.page_id = th.conv_id),
keyed AS (SELECT *, 'post_' || substring(md5(COALESCE(url, title || CAST(idx AS VARCHAR))), 1, 12) AS post_id
          FROM raw)"""


def _turn_iso(k: int) -> str:
    return (f"strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) "
            f"+ to_minutes(CAST((t + {k}) * 7 AS INTEGER)) + to_seconds(CAST((t + {k}) * 5 % 60 AS INTEGER)), "
            f"'%Y-%m-%dT%H:%M:%S')")


def _who(k: int) -> str:
    return f"'user_' || CAST((conv_id * 7 + t + {k}) % 150 AS VARCHAR)"


def _cid(k: int) -> str:
    return f"'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(t + {k} AS VARCHAR)"


_EXPECTED = "\nUNION ALL ".join(
    f"""SELECT post_id, is_json, {k} AS k, {_who(k)} AS username,
       {"CASE WHEN is_json THEN post_id || '_2_' || " + _who(k) + " ELSE " + _cid(k) + " END" if k == 2 else _cid(k)}
         AS raw_id, x{k} AS comment_text, {_turn_iso(k)} AS comment_time,
       {"''" if k == 0 else _cid(k - 1)} AS parent_comment_id
FROM keyed WHERE x{k} IS NOT NULL""" for k in range(3))

_COMMENTS_OUT = """SELECT 'comment_' || substring(md5(raw_id), 1, 12) AS comment_id, post_id,
       'user_' || substring(md5(username), 1, 12) AS user_id, username, comment_text, comment_time,
       parent_comment_id,
       CASE WHEN parent_comment_id <> '' THEN 'comment_' || substring(md5(parent_comment_id), 1, 12) ELSE '' END
         AS parent_comment_key
FROM expected"""

SQL.update({
    "comment_tree": f"WITH {_RAW},\nexpected AS ({_EXPECTED})\n{_COMMENTS_OUT}",
    "comment_repr_rows": f"WITH {_RAW},\nexpected AS ({_EXPECTED})\n{_COMMENTS_OUT} WHERE NOT is_json",
    "post_rows": f"""WITH {_RAW}
SELECT post_id, title, 'user_' || substring(md5('author_' || CAST(conv_id % 150 AS VARCHAR)), 1, 12) AS author_id,
       'author_' || CAST(conv_id % 150 AS VARCHAR) AS author, COALESCE(url, '') AS url,
       COALESCE(content, '') AS content, '' AS excerpt, COALESCE('["' || source || '"]', '') AS categories,
       COALESCE('["' || lang || '"]', '') AS tags,
       CASE WHEN thread % 2 = 0
            THEN strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)), '%Y-%m-%d')
            ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER))
                          + to_minutes(7) + to_seconds(5), '%Y-%m-%d') END AS published_at,
       CAST((x0 IS NOT NULL)::INT + (x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT AS INTEGER) AS comments_count,
       COALESCE(url, '') AS image_url,
       CASE WHEN url LIKE 'http%' THEN post_id || '.' ||
            CASE WHEN lower(string_split(split_part(url, '?', 1), '.')[-1]) IN ('jpg', 'jpeg', 'png', 'webp')
                 THEN lower(string_split(split_part(url, '?', 1), '.')[-1]) ELSE 'jpg' END
            ELSE '' END AS image_path
FROM keyed""",
})

_DEEP = """deep AS (
  SELECT conv_id // 500 AS thread, conv_id, turn, text, 'd' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS raw_id,
         'user_' || CAST((conv_id * 7 + turn) % 150 AS VARCHAR) AS username,
         'post_' || substring(md5('deep thread ' || CAST(conv_id // 500 AS VARCHAR) || 'deep_' || CAST(conv_id // 500 AS VARCHAR)), 1, 12) AS post_id
  FROM conversations)"""
SQL["deep_threads"] = f"""
WITH {_DEEP}
SELECT 'comment_' || substring(md5(raw_id), 1, 12) AS comment_id, post_id, 'user_' || substring(md5(username), 1, 12) AS user_id, username,
       COALESCE(text, '') AS comment_text,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn * 7 AS INTEGER))
                + to_seconds(CAST(turn * 5 % 60 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS comment_time,
       '' AS parent_comment_id, '' AS parent_comment_key
FROM deep"""
SQL["deep_post_rows"] = f"""
WITH {_DEEP}
SELECT post_id, 'deep thread ' || CAST(thread AS VARCHAR) AS title, CAST(count(*) AS INTEGER) AS comments_count FROM deep GROUP BY ALL"""

SQL["dead_letters"] = "SELECT url AS value FROM pages"
_ORDER_ROUTED = "SELECT ev.op, 'orders' AS \"table\", NULL AS user_id, NULL AS post_id, o.ts0 + ev.step * 1000 AS event_ts_ms, 'IGNORED' AS outcome FROM ev JOIN o ON ev.k = o.k"
SQL["routed_events"] = with_fixtures(f"""
WITH {_SI}, {ORDER_EVENTS},
p AS (SELECT post_id, CASE WHEN post_id % 7 <> 0 THEN epoch_ms(CAST(published_at_raw AS TIMESTAMP)) END AS ts,
             CASE WHEN post_id % 26 <> 0 THEN 1700000000000 + post_id END AS src FROM posts)
SELECT 'c' AS op, 'interactions' AS "table", user_id, post_id, ts_ms AS event_ts_ms,
       CASE WHEN post_id IS NULL THEN 'IGNORED' ELSE 'INTERACTION' END AS outcome FROM si
UNION ALL SELECT 'c', 'posts', NULL, CAST(post_id AS VARCHAR), COALESCE(ts, src),
       CASE WHEN COALESCE(ts, src) IS NULL THEN 'POST_WITHOUT_SCORE' ELSE 'POST_WITH_SCORE' END FROM p
UNION ALL {_ORDER_ROUTED}
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'MALFORMED' FROM pages""", "interactions", "posts")

SQL["cdc_window"] = f"WITH {ORDER_EVENTS}\n{_normalized('feedlake_cdc_public_orders')} WHERE o.k % 24 >= 6 AND o.k % 24 < 12"
SQL["staging_csv"] = with_fixtures(f"""
SELECT post_id, NULLIF(title, '') AS title, author_id, NULLIF(content, '') AS content, NULLIF(categories, '') AS categories,
       NULLIF(published_at, '') AS published_at, comments_count, NULLIF(image_url, '') AS image_url
FROM ({STAGING_POSTS}) sp""", "posts", "post_media")
SQL["partition_rewrite"] = with_fixtures("""
SELECT event_id, user_id, post_id, substring(occurred_at_raw, 1, 10) AS day,
       CASE WHEN substring(occurred_at_raw, 1, 10) = '2024-01-10' THEN 2 ELSE 1 END AS version
FROM interactions WHERE substring(occurred_at_raw, 1, 10) <> '2024-01-10' OR event_id % 2 = 0""", "interactions")
_LETTERS = ", ".join(f"length(t) - length(replace(t, '{chr(97 + i)}', ''))" for i in range(26))
SQL["model_encode"] = with_fixtures(f"""
WITH t AS (SELECT id AS post_id, lower(text) AS t FROM ({{_POST_TEXT}})),
c AS (SELECT post_id, list_transform([{_LETTERS}], lambda x: CAST(x AS DOUBLE)) AS c FROM t),
n AS (SELECT post_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c)
SELECT post_id, 26 AS dim, n AS norm, {", ".join(f"c[{i + 1}] AS v{i}" for i in (0, 4, 13, 18, 25))}
FROM n""".replace("{_POST_TEXT}", "SELECT CAST(post_id AS VARCHAR) AS id, " + """concat_ws(' ', COALESCE(title, ''), substring(COALESCE(body_text, ''), 1, 512),
                 array_to_string(""" + _F4.format(c="tags") + ", ' '), array_to_string(" + _F4.format(c="categories") + ", ' ')) AS text FROM posts"), "posts")

SQL["table_counts"] = with_fixtures("""
SELECT 'users' AS table_name, count(*) AS n_rows FROM users
UNION ALL SELECT 'posts', count(*) FROM posts
UNION ALL SELECT 'comments', count(*) FROM comments
UNION ALL SELECT 'interactions', count(*) FROM interactions
UNION ALL SELECT 'post_media', count(*) FROM post_media""", *ALL_FIXTURES)

SQL["cdc_stream_state"] = """
WITH s AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS step FROM orders)
SELECT o_orderkey, o_custkey,
       CASE WHEN step = 1 THEN (CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END) ELSE o_orderstatus END
         AS o_orderstatus,
       o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority,
       CASE WHEN step = 1 THEN 'u' ELSE 'r' END AS op,
       epoch_ms(o_orderdate) + step * 1000 AS event_ts_ms, epoch_ms(o_orderdate) + step * 1000 AS source_ts_ms,
       false AS is_delete
FROM s WHERE o_orderkey % 11 <> 0"""

SQL["staging_rejects"] = with_fixtures("""
SELECT 'users' AS table_name, CAST(user_id AS VARCHAR) AS key FROM users WHERE user_id IS NULL OR COALESCE(username, '') = ''
UNION ALL SELECT 'posts', CAST(post_id AS VARCHAR) FROM posts WHERE post_id IS NULL OR author_id IS NULL
UNION ALL SELECT 'comments', comment_id FROM comments WHERE comment_id IS NULL OR post_id IS NULL OR user_id IS NULL
UNION ALL SELECT 'interactions', CAST(event_id AS VARCHAR) FROM interactions
  WHERE event_id IS NULL OR user_id IS NULL OR post_id IS NULL OR interaction_type IS NULL""", *ALL_FIXTURES)

SQL["cascade_prune"] = with_fixtures("""
SELECT comment_id, post_id, user_id FROM comments
WHERE post_id IN (SELECT post_id FROM posts) AND user_id IN (SELECT user_id FROM users)""", "comments", "posts", "users")

SQL["feed_with_comments"] = with_fixtures(f"""
WITH page AS ({FEED_PAGE}), c AS ({_newest(3)})
SELECT page.post_id, page.title, page.author_username, c.rank, c.comment_id, c.username, c.body_text, c.commented_at
FROM page LEFT JOIN c ON c.post_id = page.post_id""", *ALL_FIXTURES)

_USER_TEXT = """SELECT CAST(user_id AS VARCHAR) AS id,
       array_to_string(CASE WHEN json_valid(interest_keywords) AND json_type(interest_keywords) = 'ARRAY'
                            THEN json_transform(interest_keywords, '["VARCHAR"]') ELSE [] END, ' ') AS text
FROM users"""
_POST_TEXT = f"""SELECT CAST(post_id AS VARCHAR) AS id,
       concat_ws(' ', COALESCE(title, ''), substring(COALESCE(body_text, ''), 1, 512),
                 array_to_string({_F4.format(c='tags')}, ' '), array_to_string({_F4.format(c='categories')}, ' ')) AS text
FROM posts"""
_ENCODED = f"""
texts AS (SELECT 'user' AS kind, * FROM ({_USER_TEXT}) UNION ALL SELECT 'post', * FROM ({_POST_TEXT})),
toks AS (SELECT kind, id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS tok FROM texts),
tf AS (SELECT kind, id, CAST(CAST('0x' || substring(md5(tok), 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, count(*) AS tf FROM toks GROUP BY ALL),
idf AS (SELECT bucket, 1 + ln(((SELECT count(*) FROM texts) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY bucket),
w AS (SELECT kind, id, bucket, tf * idf / sqrt(sum(tf * idf * (tf * idf)) OVER (PARTITION BY kind, id)) AS weight FROM tf JOIN idf USING (bucket))"""
SQL["text_encode"] = with_fixtures(f"""
WITH {_ENCODED}
SELECT id AS post_id, bucket, round(weight, 6) AS weight FROM w WHERE kind = 'post'""", "users", "posts")
SQL["text_mapping"] = with_fixtures(f"""
WITH {_ENCODED}
SELECT t.kind, t.id, 384 AS dim, round(COALESCE(sqrt(sum(w.weight * w.weight)), 0), 5) AS norm,
       round(COALESCE(max(w.weight) FILTER (WHERE w.bucket = 0), 0), 5) AS v1,
       round(COALESCE(max(w.weight) FILTER (WHERE w.bucket = 99), 0), 5) AS v100,
       round(COALESCE(max(w.weight) FILTER (WHERE w.bucket = 383), 0), 5) AS v384
FROM texts t LEFT JOIN w ON w.kind = t.kind AND w.id = t.id GROUP BY t.kind, t.id""", "users", "posts")
