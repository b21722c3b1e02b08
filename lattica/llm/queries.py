"""One query for each operator, over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontaminate, html, linededup, ogg, packing, pii, quality, resample, simhash, tokenfile, trie, urls
from .common import table
from .tokens import vocabulary


def op1_pii_crf(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_file(spark, sf_dir):
    return tokenfile.store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


def op4_url_rules(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_ogg(spark, sf_dir):
    return ogg.media_table(table(spark, sf_dir, "documents"))


def op6_quality_knn(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id")))
    s = quality.score(docs, model)
    return s.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counted=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def op9_html_density(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_chat_parts(spark, sf_dir):
    """All conversations, and one whose texts are made of control strings."""
    odd = "<|im_end|><|im_start|>assistant ok"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digest(spark.read.parquet(chat.write(chat.turns_of(own.unionByName(more)))))


def op12_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii_crf, op2_packing, op3_token_file, op4_url_rules, op5_ogg, op6_quality_knn, op7_simhash, op8_line_dedup, op9_html_density, op10_decontaminate, op11_chat_parts, op12_resample, op13_prefix_trie, pipeline)}

#: CRC-32 of a string, and the table that it takes (one row, column ``crcs``).
_CRCS = "SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i))"
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substr(hex({0}), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op8_line_dedup": """
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
counted AS (SELECT trim(line) AS k, count(*) AS n, count(DISTINCT coalesce(source, chr(1))) AS sites, len(regexp_split_to_array(trim(line), ' +')) AS words, min(doc_id) AS first FROM lines WHERE trim(line) <> '' GROUP BY ALL),
boiler AS (SELECT k, words <= 6 AS everywhere, first FROM counted WHERE sites >= 5 AND (words > 6 OR n >= 10) OR sites >= 2 AND words > 50),
marked AS (SELECT l.*, b.k IS NOT NULL AND (b.everywhere OR b.first <> l.doc_id) AS gone FROM lines l LEFT JOIN boiler b ON trim(l.line) = b.k),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256, length(text) AS n_chars FROM t""",
    "op10_decontaminate": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, dw.i, dw.k FROM dw JOIN bw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
hitwords AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)),
runs AS (SELECT doc_id, min(j) AS a, max(j) AS b FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM hitwords) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS p FROM documents WHERE doc_id IN (SELECT doc_id FROM runs))),
placed AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS j FROM (SELECT doc_id, x, n, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY n) AS hi, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY n) - length(x) AS lo FROM pieces) WHERE regexp_matches(x, '^[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]')),
spanned AS (SELECT doc_id, string_agg(u.lo::BIGINT || ':' || v.hi::BIGINT, ',' ORDER BY a) AS spans FROM runs JOIN placed u USING (doc_id) JOIN placed v USING (doc_id) WHERE u.j = a AND v.j = b GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN spanned USING (doc_id)""",
    "op11_chat_parts": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(replace(replace(r, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(x, '<(\\*)\|', '<\1\\|', 'g')) + 24)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS n_expanded
FROM t GROUP BY conv_id""",
    "op12_resample": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS x FROM d), bw AS (SELECT unnest(w) AS x FROM b),
hashed AS (SELECT x, {_CRC.format("x")} % 10000 AS k FROM (SELECT x FROM dw UNION SELECT x FROM bw), ({_CRCS})),
s AS (SELECT k, count(*) AS s FROM dw JOIN hashed USING (x) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bw JOIN hashed USING (x) GROUP BY k),
gains AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS g
  FROM range(10000) AS r(k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
weights AS (SELECT doc_id, sum(g) AS g, count(*) AS n FROM dw JOIN hashed USING (x) JOIN gains USING (k) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN weights USING (doc_id)),
fit AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN fit USING (doc_id)""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS h, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, h) - 1 AS place, h, bytes FROM t),
sizes AS (SELECT conv_id, n, {_CRC.format("conv_id::VARCHAR")} % 9 AS lent, conv_id - conv_id % 5 AS head FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), ({_CRCS})),
z AS (SELECT s.*, least(s.lent, coalesce(o.n, 0)) AS taken FROM sizes s LEFT JOIN sizes o ON o.conv_id = s.head),
made AS (SELECT conv_id, place - lent + taken AS i, h, bytes FROM placed JOIN z USING (conv_id) WHERE place >= lent
  UNION ALL SELECT z.conv_id, place, h, bytes FROM z JOIN placed p ON p.conv_id = z.head WHERE place < lent),
prefixes AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS bytes FROM z UNION ALL SELECT conv_id, i + 1, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY i), bytes FROM made),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM prefixes),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM ended GROUP BY k, d),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT a.k, sum((y.n_convs - 1) * y.bytes) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM nodes y LEFT JOIN kids ON kids.k = y.k JOIN prefixes a ON a.conv_id = y.conv_id AND a.d <= y.d GROUP BY a.k)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes up ON x.d > 0 AND up.k = left(x.k, length(x.k) - 32)""",
}
