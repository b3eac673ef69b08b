"""Transcript, caption, clip and grounding queries."""

from pyspark.sql import functions as F

from turnout.functions import fixed, text as T
from turnout.functions.similarity import word_ratio
from turnout.functions.sql import register
from turnout.operators import grounding as G, transcript as X
from turnout.queries.registry import query

@query("transcript_turns", "SRC6 DT2", """SELECT conv_id AS recording_id, turn AS seq, (turn * 30)::INTEGER AS sec, role AS speaker, trim(replace(text, chr(10), ' ')) AS text FROM {conversations} WHERE turn % 7 <> 6""")
def _(v):
    return X.turns_of(v("transcript_lines"))


@query("caption_cue_lines", "SRC6", """SELECT conv_id AS recording_id, turn AS seq, (turn * 30)::INTEGER AS sec, CASE WHEN turn % 7 = 6 THEN 'SYSTEM' ELSE role END AS speaker,
  CASE WHEN turn % 7 = 6 THEN role || ' ' ELSE '' END || trim(replace(text, chr(10), ' ')) AS text FROM {conversations}""")
def _(v):
    return X.cue_lines_of(v("transcript_lines"))


@query("merged_turns", "WIN3 STR10 SRC5", """WITH p AS (SELECT recording_id, seq, start_sec, speaker, replace(trim(text), 'the', 'The') AS text FROM {stt_pieces}),
f AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND start_sec - lag(start_sec) OVER w < 2.0 THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY start_sec, seq)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY start_sec, seq)::BIGINT AS island FROM f)
SELECT recording_id, island, min(start_sec) AS start_sec, min(speaker) AS speaker, count(*) AS pieces, string_agg(text, ' ' ORDER BY start_sec, seq) AS text FROM i GROUP BY 1, 2""")
def _(v):
    return X.merged_turns(v("stt_pieces"), fixes=[("the", "The")])


CUES = """cue AS (SELECT recording_id, seq, row_number() OVER w AS cue_no, sec AS start_sec, coalesce(lead(sec) OVER w, sec + 20) AS nxt, speaker, text FROM {turns} WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
cues AS (SELECT recording_id, seq, cue_no, start_sec, CASE WHEN nxt <= start_sec THEN start_sec + 1 ELSE nxt END AS end_sec,
  '<v ' || speaker || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS cue FROM cue)"""


@query("caption_cues", "WIN4", f"WITH {CUES} SELECT * FROM cues")
def _(v):
    return X.cues(v("turns"))


@query("caption_blocks", "SNK4 DT2", f"""WITH {CUES} SELECT recording_id, cue_no, cue_no || chr(10) || printf('%02d:%02d:%02d.000', start_sec // 3600, start_sec % 3600 // 60, start_sec % 60) || ' --> ' ||
  printf('%02d:%02d:%02d.000', end_sec // 3600, end_sec % 3600 // 60, end_sec % 60) || chr(10) || cue || chr(10) AS value FROM cues""")
def _(v):
    return X.cue_text(X.cues(v("turns")))


@query("text_windows", "WIN5", """WITH w AS (SELECT *, lead(text) OVER (PARTITION BY recording_id ORDER BY seq) AS t2, lead(speaker) OVER (PARTITION BY recording_id ORDER BY seq) AS s2 FROM {turns})
SELECT recording_id, seq, sec, 1 AS span, speaker AS label, text FROM w UNION ALL SELECT recording_id, seq, sec, 2, speaker || ' -> ' || s2, text || ' ' || t2 FROM w WHERE t2 IS NOT NULL""")
def _(v):
    return X.windows(v("turns"))


CHAP = """chap AS (SELECT event_slug, chapter, duration_sec, coalesce(sum(duration_sec) OVER (PARTITION BY event_slug ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start_abs FROM {recording_files}),
chapters AS (SELECT *, start_abs + duration_sec AS end_abs FROM chap)"""
BOUND = CHAP + ", bounds AS (SELECT event_slug, start_abs::BIGINT AS sec FROM chapters UNION SELECT event_slug, max(end_abs)::BIGINT FROM chapters GROUP BY 1)"


@query("chapters", "WIN6", f"WITH {CHAP} SELECT * FROM chapters")
def _(v):
    return X.chapters(v("recording_files"))


@query("valid_stamps", "SET4 WIN6", f"WITH {BOUND} SELECT event_slug, sec FROM bounds UNION SELECT event_slug, sec FROM {{stamps}}")
def _(v):
    return X.valid_stamps(v("stamps"), X.boundary_seconds(X.chapters(v("recording_files"))))


@query("segment_marks", "SET4", """SELECT DISTINCT doc_id AS recording_id, unnest([doc_id % 60, doc_id % 60 + 90]) AS sec FROM {documents}""")
def _(v):
    d = F.col("doc_id") % 60
    line = F.concat(F.lit("## Part ("), T.mm_ss(d), F.lit("-"), T.mm_ss(d + 90), F.lit(") "), F.col("lang"))
    return X.segment_seconds(v("documents").select(F.col("doc_id").alias("recording_id"), line.alias("line")))


SNAPPED = """pick AS (SELECT m.event_slug, m.moment_id, m.sec, arg_min(s.sec, abs(s.sec - m.sec) * 10000 + s.sec) AS near, min(abs(s.sec - m.sec)) AS drift
  FROM {moments} m JOIN {stamps} s USING (event_slug) GROUP BY 1, 2, 3)"""


@query("snapped_moments", "JN20", f"WITH {SNAPPED} SELECT event_slug, moment_id, CASE WHEN drift <= 45 THEN near ELSE -1 END AS snapped, CASE WHEN drift <= 45 THEN drift ELSE -1 END AS drift FROM pick")
def _(v):
    return X.snapped(v("moments"), v("stamps")).select(
        "event_slug", "moment_id", F.coalesce("snapped", F.lit(-1)).alias("snapped"), F.coalesce("drift", F.lit(-1)).alias("drift"))


INCHAP = CHAP + """, placed AS (SELECT m.event_slug, m.moment_id, m.sec, coalesce(c.chapter, (SELECT max(chapter) FROM chapters x WHERE x.event_slug = m.event_slug)) AS chapter
  FROM {moments} m LEFT JOIN chapters c ON c.event_slug = m.event_slug AND c.start_abs <= m.sec AND m.sec < c.end_abs)"""


@query("moment_chapters", "JN21", f"WITH {INCHAP} SELECT event_slug, moment_id, chapter FROM placed")
def _(v):
    return X.in_chapter(v("moments"), X.chapters(v("recording_files"))).select("event_slug", "moment_id", "chapter")


@query("true_speakers", "JN23", """WITH c AS (SELECT conv_id AS recording_id, turn * 15 AS sec, 'User' AS claimed, turn FROM {conversations})
SELECT c.recording_id, c.turn, coalesce(t.speaker, 'User') AS speaker, t.speaker IS NOT NULL AND t.speaker <> 'user' AS corrected FROM c LEFT JOIN {turns} t ON t.recording_id = c.recording_id AND t.sec = c.sec""")
def _(v):
    cited = v("conversations").select(F.col("conv_id").alias("recording_id"), (F.col("turn") * 15).alias("sec"), F.lit("User").alias("claimed"), "turn")
    return X.true_speaker(cited, v("turns")).select("recording_id", "turn", "speaker", "corrected")


def clip_requests(v):
    """Every valid stamp as a clip start, proposals 0-99 s on, bounded by its chapter."""
    at = X.in_chapter(v("stamps"), X.chapters(v("recording_files")))
    return at.select("event_slug", F.col("sec").alias("start"), (F.col("sec") + F.col("sec") % 100).alias("proposed"), F.floor("chapter_end").alias("upper"))


ENDS = CHAP + """, req AS (SELECT s.event_slug, s.sec AS start, s.sec + s.sec % 100 AS proposed, floor(coalesce(c.end_abs, (SELECT max(end_abs) FROM chapters x WHERE x.event_slug = s.event_slug)))::BIGINT AS upper
  FROM {stamps} s LEFT JOIN chapters c ON c.event_slug = s.event_slug AND c.start_abs <= s.sec AND s.sec < c.end_abs),
cand AS (SELECT r.*, s.sec, CASE WHEN s.sec BETWEEN r.start + 30 AND least(r.start + 60, upper) THEN 0 ELSE 1 END AS rule FROM req r JOIN {stamps} s ON s.event_slug = r.event_slug AND s.sec > r.start AND s.sec <= r.upper),
ends AS (SELECT event_slug, start, sec AS pick FROM (SELECT *, row_number() OVER (PARTITION BY event_slug, start ORDER BY rule, CASE rule WHEN 0 THEN abs(sec - proposed) ELSE abs(sec - start - 45) END, sec) AS rn FROM cand) WHERE rn = 1)"""


@query("clip_ends", "WIN13", f"WITH {ENDS} SELECT r.event_slug, r.start, coalesce(e.pick, -1) AS clip_end FROM req r LEFT JOIN ends e USING (event_slug, start)")
def _(v):
    return X.clip_ends(clip_requests(v), v("stamps")).select("event_slug", "start", F.coalesce("end", F.lit(-1)).alias("clip_end"))


def wanted(v):
    return v("stt_pieces").groupBy("recording_id").agg(
        (F.max("start_sec") * 0.4 + 3).alias("want_start"), (F.max("end_sec") + 9).alias("length"))


CLIPS = """want AS (SELECT recording_id, max(start_sec) * 0.4 + 3 AS want_start, max(end_sec) + 9 AS length FROM {stt_pieces} GROUP BY 1),
st AS (SELECT w.*, arg_min(p.start_sec, abs(p.start_sec - w.want_start) * 100000 + p.start_sec) AS s FROM want w JOIN {stt_pieces} p USING (recording_id) GROUP BY ALL),
en AS (SELECT st.recording_id, want_start, length, s, coalesce(arg_min(p.end_sec, p.start_sec * 1000 + p.seq) FILTER (WHERE p.end_sec - s >= 30), arg_max(p.end_sec, p.start_sec * 1000 + p.seq)) AS e0
  FROM st JOIN {stt_pieces} p USING (recording_id) GROUP BY ALL),
ec AS (SELECT *, least(e0, s + 60) AS e FROM en),
clip AS (SELECT recording_id, round_even(CASE WHEN e - s < 30 THEN greatest(0.0, least(s, least(s + 35, length) - 30)) ELSE s END, 2) AS clip_start,
  round_even(least(length, CASE WHEN e - s < 30 THEN least(s + 35, length) ELSE e END), 2) AS clip_end FROM ec)"""


@query("clip_windows", "TXT9", f"WITH {CLIPS} SELECT recording_id, clip_start::DOUBLE AS clip_start, clip_end::DOUBLE AS clip_end FROM clip")
def _(v):
    return X.clip_windows(wanted(v), v("stt_pieces")).select("recording_id", "clip_start", "clip_end")


LINES = """raw AS (SELECT recording_id, seq, start_sec, end_sec, list_reduce(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''),
    lambda a, w: CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(w) <= 42 THEN a || ' ' || w ELSE a || chr(10) || w END) AS folded FROM {stt_pieces}),
split AS (SELECT *, string_split(folded, chr(10)) AS ls FROM raw),
lines AS (SELECT recording_id, seq, start_sec, end_sec, i AS line_no, ls[i + 1] AS line, greatest(0.4, end_sec - start_sec) AS span,
    coalesce(list_sum(list_transform(ls[1:i], lambda x: length(x))), 0) AS c0, list_sum(list_transform(ls[1:i + 1], lambda x: length(x))) AS c1, greatest(1, list_sum(list_transform(ls, lambda x: length(x)))) AS tot
  FROM split, unnest(range(0, len(ls))) AS r(i)),
timed AS (SELECT *, start_sec + span * c0 / tot AS line_start, start_sec + span * c1 / tot AS line_end FROM lines)"""


@query("caption_lines", "STR7 WIN11", f"WITH {LINES} SELECT recording_id, seq, line_no::INTEGER AS line_no, line, round(line_start, 4) AS line_start, round(line_end, 4) AS line_end FROM timed")
def _(v):
    return X.caption_lines(v("stt_pieces")).select("recording_id", "seq", "line_no", "line", F.round("line_start", 4).alias("line_start"), F.round("line_end", 4).alias("line_end"))


@query("clip_captions", "JN22 WIN11", f"""WITH {CLIPS}, {LINES} SELECT t.recording_id, seq, line_no::INTEGER AS line_no, round_even(greatest(line_start, clip_start) - clip_start, 3) AS from_sec, round_even(least(line_end, clip_end) - clip_start, 3) AS to_sec, line AS text
FROM timed t JOIN clip c USING (recording_id) WHERE end_sec > clip_start AND start_sec < clip_end AND least(line_end, clip_end) - greatest(line_start, clip_start) >= 0.25""")
def _(v):
    clips = X.clip_windows(wanted(v), v("stt_pieces")).withColumn("clip_id", F.lit(1))
    return X.captions(X.caption_lines(v("stt_pieces")), clips).drop("clip_id")


def srt(c):
    return f"printf('%02d:%02d:%02d,%03d', floor({c})::BIGINT // 3600, floor({c})::BIGINT % 3600 // 60, floor({c})::BIGINT % 60, round_even(({c} - floor({c})) * 1000, 0)::BIGINT)"


@query("subtitle_blocks", "SNK4 DT2", f"""WITH {CLIPS}, {LINES}, cap AS (SELECT t.recording_id, seq, line_no, round_even(greatest(line_start, clip_start) - clip_start, 3) AS a, round_even(least(line_end, clip_end) - clip_start, 3) AS b, line
  FROM timed t JOIN clip c USING (recording_id) WHERE end_sec > clip_start AND start_sec < clip_end AND least(line_end, clip_end) - greatest(line_start, clip_start) >= 0.25),
num AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY a, seq, line_no) AS block_no FROM cap)
SELECT recording_id, 1 AS clip_id, block_no, block_no || chr(10) || {srt('a')} || ' --> ' || {srt('b')} || chr(10) || line || chr(10) AS value FROM num""")
def _(v):
    clips = X.clip_windows(wanted(v), v("stt_pieces")).withColumn("clip_id", F.lit(1))
    return X.caption_text(X.captions(X.caption_lines(v("stt_pieces")), clips))


@query("work_windows", "SRC8", """SELECT event_slug, chapter, (i * 120)::DOUBLE AS from_sec, least(i * 120 + 120, duration_sec)::DOUBLE AS to_sec FROM {recording_files}, unnest(range(0, ceil(duration_sec / 120)::BIGINT)) AS r(i)""")
def _(v):
    return X.work_windows(v("recording_files"), 120.0).select("event_slug", "chapter", F.col("from_sec").cast("double").alias("from_sec"), "to_sec")


@query("best_moments", "TOP7", """SELECT event_slug, moment_id, worth, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY worth DESC, moment_id) AS rank FROM {moments}) WHERE rank <= 3""")
def _(v):
    return X.best_moments(v("moments")).select("event_slug", "moment_id", "worth", "rank")


@query("clock_strings", "DT1 DT2", """SELECT event_id, (user_id * 37 % 5000)::INTEGER AS seconds, printf('%02d:%02d', user_id * 37 % 5000 // 60, user_id * 37 % 5000 % 60) AS mm_ss,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS zoned, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS millis, true AS bad_is_null FROM {events}""")
def _(v):
    s, f = F.col("user_id") * 37 % 5000, "yyyy-MM-dd HH:mm:ss"
    show = lambda c: F.date_format(T.naive_utc(c), f)
    whole = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return v("events").select(
        "event_id", T.seconds_of(T.mm_ss(s)).alias("seconds"), T.mm_ss(s).alias("mm_ss"), show(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"),
        show(F.concat(F.date_format(whole + F.make_dt_interval(hours=F.lit(2)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("zoned"),
        show(F.unix_millis(whole).cast("string")).alias("millis"), T.naive_utc(F.concat(F.lit("x"), F.col("event_type"))).isNull().alias("bad_is_null"))


# --- grounding ----------------------------------------------------------------------------
NORM = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@query("quote_locations", "JN24", f"""SELECT b.item_id, min(d.doc_id) AS doc_id FROM {{benchmark}} b JOIN {{documents}} d ON contains({NORM.format(c='d.text')}, {NORM.format(c='b.text')}) GROUP BY 1""")
def _(v):
    q = v("benchmark").select("item_id", F.lit("all").alias("event_slug"), T.spaced(F.col("text")).alias("quote"))
    t = v("documents").select(F.lit("all").alias("event_slug"), "doc_id", T.spaced(F.col("text")).alias("body"))
    hit = G.contained(q, t, ["event_slug"], "quote", "body", "doc_id")
    return q.join(hit, ["event_slug", "quote"]).select("item_id", "doc_id")


def spoken_windows(v):
    return X.windows(v("spoken").withColumnRenamed("event_slug", "recording_id")).withColumnRenamed("recording_id", "event_slug")


def roster(v):
    return v("spoken").select("event_slug", F.col("speaker").alias("name")).distinct()


@query("claims", "TXT1 TXT2 TXT3 UDTF1")
def _(v):
    return G.claims(v("assets")).select("event_slug", "asset_id", "claim_no", "type", "raw", "stamp", "name")


@query("stamp_claims", "TXT1", """SELECT asset_id, count(*) AS n FROM (SELECT asset_id, unnest(regexp_extract_all(text, '\\[\\d\\d?:\\d\\d\\]')) AS s FROM {assets}) GROUP BY 1""")
def _(v):
    return G.claims(v("assets")).filter("type = 'timestamp'").groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))


SAID = "trim(regexp_replace(text, '[^A-Za-zÀ-ÿ ]', ''{g}))"


@query("claims_sql", "UDTF1 TXT1 TXT2", f"""WITH s AS (SELECT event_slug, seq, sec, {SAID.format(g=", 'g'")} AS said FROM {{spoken}}),
a AS (SELECT event_slug, seq, said, lpad((sec // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS mark FROM s)
SELECT event_slug, seq, 0 AS claim_no, 'timestamp' AS type, '[' || mark || ']' AS raw, mark AS stamp, NULL AS name FROM a
UNION ALL SELECT event_slug, seq, 1, 'quote', said, NULL, NULL FROM a WHERE length(said) >= {fixed.QUOTE_MIN}
UNION ALL SELECT event_slug, seq, CASE WHEN length(said) >= {fixed.QUOTE_MIN} THEN 2 ELSE 1 END, 'attribution', 'Dana Cole', NULL, 'Dana Cole' FROM a""")
def _(v):
    register(v.spark)
    texts = v.sql(f"""SELECT event_slug, seq, '"' || {SAID.format(g='')} || '" as was heard [' || lpad(CAST(sec AS INT) DIV 60 % 60, 2, '0') || ':' || lpad(CAST(sec AS INT) % 60, 2, '0') || ']'
      || chr(10) || '-- Dana Cole, Acme' AS text FROM {{spoken}}""")
    return v.spark.sql("SELECT t.event_slug, t.seq, c.claim_no, c.type, c.raw, c.stamp, c.name FROM {texts} AS t, LATERAL claims_of(t.text) AS c", texts=texts)


def verdicts(v):
    marks = X.valid_stamps(v("spoken").select("event_slug", "sec"))
    return G.verified_claims(G.claims(v("assets")), v("spoken"), spoken_windows(v), marks, roster(v))


@query("verified_claims", "TXT4 JN23 JN25 JN26 UDF2")
def _(v):
    return verdicts(v).select("event_slug", "asset_id", "claim_no", "type", "verified", F.round("ratio", 6).alias("ratio"), "window", "place", "reason")


@query("quote_fragments", "TXT4 JN25 UDF2")
def _(v):
    spans = G.quotes_of_speakers(G.claims(v("assets")), roster(v))
    return G.verified_fragments(spans, spoken_windows(v)).select(
        "event_slug", "asset_id", "claim_no", "fragment_no", "quote", F.round("ratio", 6).alias("ratio"), "window", "place", "verified")


@query("verified_stamps", "TXT4", """SELECT asset_id, s AS raw, split_part(s, ':', 1)::INT * 60 + split_part(s, ':', 2)::INT IN (SELECT sec FROM {spoken} t WHERE t.event_slug = c.event_slug) AS verified FROM (
  SELECT event_slug, asset_id, unnest(regexp_extract_all(text, '\\[(\\d\\d?:\\d\\d)\\]', 1)) AS s FROM {assets}) c""")
def _(v):
    return verdicts(v).filter("type = 'timestamp'").select("asset_id", F.btrim(F.col("raw"), F.lit("[]")).alias("raw"), "verified")


@query("fuzzy_quotes", "JN25 UDF2")
def _(v):
    lines = v("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("event_slug"), F.posexplode(F.split("text", r"\n")).alias("seq", "text"))
    long = lines.filter(F.length("text") >= 60)
    q = long.select("event_slug", F.concat(F.substring("text", 1, 20), F.lit("zz "), F.substring("text", F.lit(21), F.length("text"))).alias("quote"))
    w = lines.select("event_slug", "seq", F.lit(1).alias("span"), F.lit("").alias("label"), "text")
    return G.closest_windows(q, w, ["event_slug"]).select("event_slug", "quote", "seq", F.round("ratio", 6).alias("ratio"))


@query("located_quotes", "JN24 JN25 TXT8")
def _(v):
    q = G.claims(v("assets")).filter("type = 'quote'").select("event_slug", F.col("asset_id").alias("quote_no"), F.col("raw").alias("quote"))
    return G.located_quotes(q, v("spoken"), spoken_windows(v), ["event_slug"]).select(
        "event_slug", "quote_no", "said_by", "sec", F.round("ratio", 6).alias("ratio"))


@query("grounding_totals", "AGG24", """SELECT event_slug, coalesce(asset_id, '*') AS asset_id, count(*) AS checked, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE NOT verified) AS failed, bool_and(verified) AS passed
  FROM {verdicts} GROUP BY GROUPING SETS ((event_slug), (event_slug, asset_id))""")
def _(v):
    return G.grounding_totals(v("verdicts")).withColumn("asset_id", F.coalesce("asset_id", F.lit("*")))


@query("failure_digest", "TXT14", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_slug, asset_id ORDER BY claim_no, type) AS rn, count(*) OVER (PARTITION BY event_slug, asset_id) AS failed FROM {verdicts} WHERE NOT verified),
n AS (SELECT event_slug, asset_id, count(*) AS checked FROM {verdicts} GROUP BY 1, 2)
SELECT f.event_slug, f.asset_id, checked, failed, '> ' || failed || ' of ' || checked || ' claims did not verify' || chr(10) || string_agg('> - [' || type || '] ' || raw || ': ' || reason, chr(10) ORDER BY rn) ||
  CASE WHEN failed > 5 THEN chr(10) || '> - ...and ' || (failed - 5) || ' more' ELSE '' END AS banner FROM f JOIN n USING (event_slug, asset_id) WHERE rn <= 5 GROUP BY 1, 2, 3, 4""")
def _(v):
    return G.failure_digest(v("verdicts"))


KEY = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query("strict_grounding", "TXT5 STR2", f"""WITH q AS (SELECT event_slug, asset_id AS scope, unnest(regexp_extract_all(text, '"([^"]+)"', 1)) AS value FROM {{assets}}),
t AS (SELECT event_slug, asset_id AS scope, unnest(regexp_extract_all(text, '\\[(\\d\\d?:\\d\\d)\\]', 1)) AS value FROM {{assets}})
SELECT event_slug, scope, 'quote' AS kind, value, {KEY.format(c='value')} <> '' AND EXISTS (SELECT 1 FROM {{spoken}} s WHERE s.event_slug = q.event_slug AND contains({KEY.format(c='s.text')}, {KEY.format(c='value')})) AS passed FROM q
UNION ALL SELECT event_slug, scope, 'timestamp', value, EXISTS (SELECT 1 FROM {{spoken}} s WHERE s.event_slug = t.event_slug AND printf('%02d:%02d', sec // 60, sec % 60) = value) FROM t""")
def _(v):
    lines = v("spoken").select("event_slug", F.col("seq").alias("line_no"), F.concat(F.lit("["), T.mm_ss(F.col("sec")), F.lit("] "), F.col("text")).alias("line"))
    texts = v("assets").select("event_slug", F.col("asset_id").alias("scope"), "text")
    return G.strict_checks(texts, lines, roster(v)).select("event_slug", "scope", "kind", "value", "passed")


@query("loose_grounding", "TXT5", f"""WITH q AS (SELECT event_slug, asset_id AS scope, unnest(regexp_extract_all(text, '"([^"]+)"', 1)) AS value FROM {{assets}}),
k AS (SELECT *, {KEY.format(c='value')} AS key FROM q), t AS (SELECT event_slug, asset_id AS scope, unnest(regexp_extract_all(text, '\\[(\\d\\d?:\\d\\d)\\]', 1)) AS value FROM {{assets}}),
r AS (SELECT DISTINCT event_slug, {KEY.format(c='speaker')} AS name FROM {{spoken}})
SELECT event_slug, scope, 'quote' AS kind, value, key <> '' AND (EXISTS (SELECT 1 FROM {{spoken}} s WHERE s.event_slug = k.event_slug AND contains({KEY.format(c='s.text')}, key))
  OR EXISTS (SELECT 1 FROM r WHERE r.event_slug = k.event_slug AND name <> '' AND (contains(key, name) OR contains(name, key)))) AS passed FROM k
UNION ALL SELECT event_slug, scope, 'timestamp', value, false FROM t""")
def _(v):
    lines = v("spoken").select("event_slug", F.col("seq").alias("line_no"), F.col("text").alias("line"))
    texts = v("assets").select("event_slug", F.col("asset_id").alias("scope"), "text")
    return G.strict_checks(texts, lines, roster(v), strict=False).select("event_slug", "scope", "kind", "value", "passed")


@query("undefined_stats", "TXT6", """WITH a AS (SELECT event_slug, asset_id, n_chars % 5 AS p, n_chars % 9 AS r FROM {spec_assets} s JOIN {documents} d ON d.doc_id = s.asset_id WHERE kind = 'infographic.md')
SELECT event_slug, asset_id, p::INTEGER AS points, r::INTEGER AS stat FROM a WHERE r > p UNION SELECT event_slug, asset_id, p::INTEGER, 2 FROM a WHERE 2 > p""")
def _(v):
    return G.undefined_stats(v("spec_assets"))


@query("post_counts", "AGG31", """SELECT event_slug, asset_id, (n_chars % 4 + 1) + n_chars % 5 AS posts, n_chars % 4 + 1 AS linkedin, n_chars % 5 AS x, 0::BIGINT AS other,
  n_chars % 4 + 1 + CASE WHEN n_chars % 3 = 0 THEN n_chars % 5 ELSE 0 END AS hooks, (1 + CASE WHEN n_chars % 3 = 0 AND n_chars % 5 > 0 THEN 1 ELSE 0 END)::BIGINT AS distinct_hooks
FROM {spec_assets} s JOIN {documents} d ON d.doc_id = s.asset_id WHERE kind = 'social.md'""")
def _(v):
    return G.post_counts(v("spec_assets").filter("kind = 'social.md'"))


@query("asset_spec", "TXT7 STR8", """WITH a AS (SELECT s.*, d.n_chars AS n, CASE WHEN trim(s.text) = '' THEN 0 ELSE len(string_split_regex(trim(s.text), '\\s+')) END AS w FROM {spec_assets} s JOIN {documents} d ON d.doc_id = s.asset_id),
b AS (SELECT *, n % 4 + 1 AS li, n % 5 AS xs, n % 4 + 1 + CASE WHEN n % 3 = 0 THEN n % 5 ELSE 0 END AS hooks FROM a)
SELECT event_slug, asset_id, kind, CASE kind
  WHEN 'blog.md' THEN CASE WHEN w < 800 THEN w || ' words, add ' || (800 - w) WHEN w > 1200 THEN w || ' words, cut ' || (w - 1200) ELSE '' END
  WHEN 'social.md' THEN CASE WHEN li + xs < 5 THEN (li + xs) || ' posts, add ' || (5 - li - xs) WHEN li < 3 OR xs < 2 THEN 'mix linkedin=' || li || ' x=' || xs || ' other=0'
     WHEN hooks < li + xs THEN 'hooks on ' || hooks || ' of ' || (li + xs) || ' posts' ELSE 'hook styles repeat' END
  WHEN 'youtube.md' THEN CASE WHEN n % 7 = 0 THEN 'missing ## Thumbnail Brief' WHEN n % 6 + 1 < 3 THEN (n % 6 + 1) || ' chapter markers' WHEN n % 5 = 0 THEN 'chapters do not start at 00:00'
     WHEN NOT EXISTS (SELECT 1 FROM {stamps} t WHERE t.event_slug = b.event_slug AND t.sec = 300 + n % 10) THEN (n % 6) || ' chapter marks not in the transcript' ELSE '' END
  ELSE CASE WHEN (n % 5) * 2 < 6 THEN ((n % 5) * 2) || ' data points' ELSE '' END END AS problem FROM b""")
def _(v):
    return G.spec_problems(v("spec_assets"), v("stamps"))


@query("tagged_assets", "STR6", """SELECT asset_id, kind, len(regexp_extract_all(text, '\\[link\\]')) AS tagged, 0 AS untagged FROM {spec_assets} WHERE kind = 'social.md'""")
def _(v):
    out = G.tagged_assets(v("spec_assets"), v("event_dim")).filter("kind = 'social.md'")
    return out.select("asset_id", "kind", F.regexp_count("text", F.lit(r"\[recording\]\(https://watch\.example\.com/v/\d\?utm_source=(linkedin|x)&x=1&utm_medium=social")).cast("bigint").alias("tagged"),
                      F.regexp_count("text", F.lit(r"\[link\]")).alias("untagged"))


def raw_moments(v):
    return v("moments").select("event_slug", "moment_id", "title", "sec", (F.col("sec") + 40).alias("end_sec"), (F.col("worth") / 100).alias("worth"), F.lit("Nobody").alias("claimed"))


def stage_turns(v):
    return v("stamps").select("event_slug", "sec", F.col("sec").alias("seq"), F.concat(F.lit("speaker-"), (F.col("sec") % 3).cast("string")).alias("speaker"))


def moments(v):
    return G.normalised_moments(raw_moments(v), v("stamps"), X.chapters(v("recording_files")), stage_turns(v))


NORMALISED = CHAP + """, p1 AS (SELECT m.event_slug, m.moment_id, m.worth, arg_min(s.sec, abs(s.sec - m.sec) * 10000 + s.sec) AS st, min(abs(s.sec - m.sec)) AS d1,
    arg_min(s.sec, abs(s.sec - m.sec - 40) * 10000 + s.sec) AS en, min(abs(s.sec - m.sec - 40)) AS d2 FROM {moments} m JOIN {stamps} s USING (event_slug) GROUP BY 1, 2, 3),
p2 AS (SELECT *, CASE WHEN d1 <= 45 THEN st END AS start, CASE WHEN d2 <= 45 THEN en END AS proposed FROM p1),
p3 AS (SELECT p.*, coalesce(c.chapter, l.chapter) AS chapter, coalesce(c.end_abs, l.end_abs) AS cend FROM p2 p LEFT JOIN chapters c ON c.event_slug = p.event_slug AND c.start_abs <= start AND start < c.end_abs
  JOIN (SELECT event_slug, max(chapter) AS chapter, max(end_abs) AS end_abs FROM chapters GROUP BY 1) l ON l.event_slug = p.event_slug),
open AS (SELECT * FROM p3 WHERE start IS NOT NULL AND start < cend - 30),
cand AS (SELECT o.event_slug, o.moment_id, o.start, o.proposed, s.sec, CASE WHEN s.sec BETWEEN o.start + 30 AND least(o.start + 60, floor(cend)) THEN 0 ELSE 1 END AS rule FROM open o JOIN {stamps} s ON s.event_slug = o.event_slug AND s.sec > o.start AND s.sec <= floor(cend)),
best AS (SELECT event_slug, moment_id, sec AS fin FROM (SELECT *, row_number() OVER (PARTITION BY moment_id ORDER BY rule, CASE rule WHEN 0 THEN abs(sec - coalesce(proposed, start + 45)) ELSE abs(sec - start - 45) END, sec) AS rn FROM cand) WHERE rn = 1)"""


@query("normalised_moments", "TXT8 WIN13 JN20 JN21", f"""WITH {NORMALISED} SELECT o.event_slug, o.moment_id, 'speaker-' || (start % 3) AS speaker, start, fin - start AS duration, (worth / 100)::DOUBLE AS worth, chapter FROM open o JOIN best USING (event_slug, moment_id)""")
def _(v):
    return moments(v)[0].select("event_slug", "moment_id", "speaker", "start", "duration", "worth", "chapter")


@query("dropped_moments", "TXT8", f"""WITH {NORMALISED} SELECT event_slug, moment_id, CASE WHEN start IS NULL THEN 'start bears on no mark' ELSE 'too close to the chapter''s end' END AS reason FROM p3 WHERE start IS NULL OR start >= cend - 30
UNION ALL SELECT event_slug, moment_id, 'no end within reach' FROM open WHERE moment_id NOT IN (SELECT moment_id FROM best)""")
def _(v):
    return moments(v)[1]


@query("transcript_similarity", "TXT13 UDF1")
def _(v):
    b = v("turns").select("recording_id", (F.col("seq") + 1).alias("seq"), F.col("text").alias("previous"))
    return v("turns").join(b, ["recording_id", "seq"]).select("recording_id", "seq", F.round(word_ratio("previous", "text"), 6).alias("ratio"))


@query("source_drift", "HSH1", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'new' ELSE 'changed' END AS state FROM {documents} WHERE lang = 'fr' OR (lang = 'de' AND sha256(text) <> sha256(upper(text)))""")
def _(v):
    now = G.fingerprints(v("documents"), "doc_id", "text")
    old = G.fingerprints(v("documents").filter("lang <> 'fr'").withColumn("text", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))), "doc_id", "text")
    return G.drifted(now, old, "doc_id")


@query("fingerprints", "HSH1", "SELECT doc_id, sha256(text) AS sha256 FROM {documents}")
def _(v):
    return G.fingerprints(v("documents"), "doc_id", "text")


@query("json_answers", "STR9 JSN1", """SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE (user_id % 50)::VARCHAR END AS k FROM {events}""")
def _(v):
    k = F.to_json(F.struct((F.col("user_id") % 50).alias("k"), F.col("event_type").alias("t")))
    body = F.when(F.col("event_type") == "click", F.concat(F.lit("Here you go:\n```json\n"), k, F.lit("\n```\nDone."))).when(
        F.col("event_type") == "view", F.concat(F.lit("Sure. "), k, F.lit(" That is all."))).when(F.col("event_type") == "error", F.lit("no answer {")).otherwise(k)
    part = T.json_part(body)
    return v("events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json(part), "$.k", "string"), F.lit("")).alias("k"))


@query("markdown_sections", "STR13 STR5 STR8", """SELECT asset_id, CASE kind WHEN 'infographic.md' THEN 'A' ELSE '' END AS headline, len(regexp_extract_all(text, '#+ ')) AS marks FROM {spec_assets} WHERE kind <> 'blog.md'""")
def _(v):
    a = v("spec_assets").filter("kind <> 'blog.md'")
    return a.select("asset_id", T.section(F.col("text"), "Headline Options").alias("headline"), F.regexp_count("text", F.lit("#+ ")).cast("bigint").alias("marks"))


@query("coerced_answers", "STR11", """SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'anomalies' WHEN 2 THEN 'committees' WHEN 3 THEN 'narrative' WHEN 4 THEN 'narrative' END AS key,
  CASE event_id % 7 WHEN 0 THEN '{"k":' || user_id || '}' WHEN 1 THEN '[{"metric":"m' || user_id || '"}]' WHEN 2 THEN '[{"x":1},{"company":"c' || user_id || '"}]'
    WHEN 3 THEN 'a' || user_id || ' b' WHEN 4 THEN 'text ' || user_id END AS payload,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'anomalies: bare list taken as anomalies' WHEN 2 THEN 'committees: bare list taken as committees'
    WHEN 3 THEN 'movement_narrative: bare list taken as narrative' WHEN 4 THEN 'movement_narrative: bare text taken as narrative'
    WHEN 5 THEN 'interest_scores: bare list taken as nothing' ELSE 'anomalies: no object, left out' END AS note FROM {events}""")
def _(v):
    n, who = F.col("event_id") % 7, F.col("user_id").cast("string")
    purposes = ("anomalies", "anomalies", "committees", "movement_narrative", "movement_narrative", "interest_scores", "anomalies")
    bodies = (F.concat(F.lit('{"k":'), who, F.lit("}")), F.concat(F.lit('[{"metric":"m'), who, F.lit('"}, 3]')),
              F.concat(F.lit('[{"x":1},{"company":"c'), who, F.lit('"}]')), F.concat(F.lit('["a'), who, F.lit('", 7, "b"]')),
              F.concat(F.lit('" text '), who, F.lit('"')), F.lit('[{"company":"c"}]'), F.lit("17"))
    purpose = body = F
    for k, (p, b) in enumerate(zip(purposes, bodies)):
        purpose, body = purpose.when(n == k, p), body.when(n == k, b)
    return v("events").select("event_id", T.coerced_answer(purpose, body).alias("a")).select("event_id", "a.*")


@query("kept_quotes", "TXT8 JN24", """WITH q AS (SELECT event_slug, seq AS quote_no, trim(trim(text), '"') AS quote FROM {spoken} WHERE seq % 2 = 0),
f AS (SELECT q.*, min(t.seq) AS at FROM q JOIN {spoken} t ON t.event_slug = q.event_slug AND contains(lower(trim(regexp_replace(t.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(q.quote, '\\s+', ' ', 'g'))))
  WHERE length(q.quote) >= 25 GROUP BY ALL)
SELECT f.event_slug, quote_no, quote, t.speaker, t.sec::BIGINT AS sec, 'topic' AS topic, 1.0::DOUBLE AS ratio FROM f JOIN {spoken} t ON t.event_slug = f.event_slug AND t.seq = f.at""")
def _(v):
    return _quotes(v)[0].drop("chapter").withColumn("sec", F.col("sec").cast("bigint"))


@query("dropped_quotes", "TXT8", """SELECT event_slug, seq AS quote_no, substr(trim(trim(text), '"'), 1, 90) AS quote, 'too short to verify' AS reason FROM {spoken} WHERE seq % 2 = 0 AND length(trim(trim(text), '"')) < 25
UNION ALL SELECT event_slug, seq, repeat('q', 90), 'no window reaches 0.90' FROM {spoken} WHERE seq % 2 = 1""")
def _(v):
    return _quotes(v)[1]


def _quotes(v):
    """Every other turn quoted whole, and as many quotes that nobody said."""
    said = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('"'), F.col("text"), F.lit('"'))).otherwise(F.lit("q" * 100))
    raw = v("spoken").select("event_slug", F.col("seq").alias("quote_no"), said.alias("quote"), F.lit("topic").alias("topic"))
    parts = v("spoken").groupBy("event_slug").agg(F.max("sec").alias("_end")).select(
        "event_slug", F.lit(1).alias("chapter"), F.lit(0.0).alias("start_abs"), (F.col("_end") + 1.0).alias("end_abs"))
    return G.normalised_quotes(raw, v("spoken"), spoken_windows(v), parts)


POINTS = CHAP + """, d AS (SELECT m.event_slug, m.moment_id, arg_min(s.sec, abs(s.sec - m.sec) * 10000 + s.sec) AS st, min(abs(s.sec - m.sec)) AS off FROM {moments} m JOIN {stamps} s USING (event_slug) GROUP BY 1, 2),
p AS (SELECT d.*, coalesce(c.chapter, l.chapter) AS chapter FROM d LEFT JOIN chapters c ON c.event_slug = d.event_slug AND c.start_abs <= st AND st < c.end_abs
  JOIN (SELECT event_slug, max(chapter) AS chapter FROM chapters GROUP BY 1) l ON l.event_slug = d.event_slug)"""


def raw_points(v):
    return v("moments").select("event_slug", F.col("moment_id").alias("point_no"), F.concat(F.lit(" v"), "moment_id", F.lit(" ")).alias("value"), F.lit("what").alias("what"), "sec", F.lit("Nobody").alias("claimed"))


@query("data_points", "TXT8 JN20 JN23", f"WITH {POINTS} SELECT event_slug, moment_id AS point_no, 'v' || moment_id AS value, 'what' AS what, 'speaker-' || (st % 3) AS speaker, st AS sec, chapter FROM p WHERE off <= 45")
def _(v):
    return G.normalised_points(raw_points(v), v("stamps"), X.chapters(v("recording_files")), stage_turns(v))[0]


@query("insights", "TXT8", f"""WITH {POINTS} SELECT event_slug, moment_id AS insight_no, CASE WHEN off <= 45 THEN 'speaker-' || (st % 3) ELSE 'Nobody' END AS speaker,
  CASE WHEN off <= 45 THEN st END AS sec, CASE WHEN off <= 45 THEN chapter END AS chapter FROM p""")
def _(v):
    raw = raw_points(v).select("event_slug", F.col("point_no").alias("insight_no"), F.col("value").alias("insight"), F.lit("so").alias("so_what"), "sec", "claimed")
    return G.normalised_insights(raw, v("stamps"), X.chapters(v("recording_files")), stage_turns(v)).select("event_slug", "insight_no", "speaker", "sec", "chapter")
