"""The registered queries: each applies one operator to its whole table.

``QUERIES`` maps a name to ``f(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds
the DuckDB text for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, staged, table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.hyperminhash import near_duplicates
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.prefix_trie import conversation_turns, prefix_trie, rebuilt
from tidemark.llm.quality import quality
from tidemark.llm.quotations import reply_links
from tidemark.llm.secrets import secret_scan
from tidemark.llm.spelling import spelling_groups, word_counts
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.token_records import token_records
from tidemark.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src
  FROM documents),
c AS (
  SELECT *, CASE WHEN size < 16 THEN size
                 ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::BIGINT) END AS cls FROM d),
s AS (SELECT src, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1) AS w,
         source_size * 2.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER ()
               - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
  FROM w),
t AS (
  SELECT src, source_size,
         coalesce(least(cap, max(CASE WHEN lv <= cap / w THEN lv END) OVER () * w), cap) AS target FROM f),
r AS (
  SELECT doc_id, src, size,
         row_number() OVER (PARTITION BY src ORDER BY cls, size, doc_id NULLS FIRST)::DOUBLE AS i FROM c),
x AS (
  SELECT doc_id, size, source_size, target, i,
         ('0x' || substr(md5('mix' || src), 1, 3))::INT / 4096.0::DOUBLE AS u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS rate
  FROM r JOIN t USING (src))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (least(floor(u + rate * i) - floor(u + rate * (i - 1)), ceil(rate)) * size)::BIGINT AS taken
FROM x
"""


@_query("op1_mix_sources", OP1_SQL)
def op1(spark, sf_dir):
    """Every document's words in the 5 : 2 : 1 mix of 150 % of all words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix_sources(staged(docs, "op1-sizes"), F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iwin AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, j, j + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM iw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN iwin USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_query("op3_decontaminate", OP3_SQL)
def op3(spark, sf_dir):
    """Every document's overlap with the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS dig FROM pages),
f AS (SELECT dig, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY dig)
SELECT page_id, n::BIGINT AS payload_bytes, dig AS payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p LEFT JOIN f USING (dig)
"""


@_query("op7_warc", OP7_SQL)
def op7(spark, sf_dir):
    """Every page through a dictionary-compressed archive and back."""
    return warc_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@_query("op8_token_records")
def op8(spark, sf_dir):
    """Every document as token ids in record files and back."""
    return token_records(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE n > 1),
l AS (SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(n_removed, 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
      FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@_query("op4_substring_dedup", OP4_SQL)
def op4(spark, sf_dir):
    """Every document without the 20-word windows that occur earlier."""
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 5) - 1) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM l JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


@_query("op2_ngram_join", OP2_SQL)
def op2(spark, sf_dir):
    """Every document's component of links at 80 % of 5-word shingles."""
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op5_quality")
def op5(spark, sf_dir):
    """Every document's statistics and the verdict of the quality rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op9_secrets")
def op9(spark, sf_dir):
    """Every document's secrets."""
    return secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@_query("op6_quotations")
def op6(spark, sf_dir):
    """Every message without quotes, with what it answers and its place in that order."""
    found = reply_links(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", F.sha2("body", 256).alias("body_sha256"), "n_quoted", "depth", "n_linked", "reply_conv", "reply_turn", "thread", "root_turn", "place")


@_query("op10_line_dedup")
def op10(spark, sf_dir):
    """Every document's lines that equal, or nearly equal, an earlier line."""
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("removed", 256).alias("removed_sha256"))


OP13_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS k, hex(encode(id || run)) AS b FROM r WHERE length(run) >= 7 GROUP BY id, run),
h AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(b) // 2), lambda i:
           list_transform(range(0, 8), lambda j: (('0x' || b[2 * i + 1: 2 * i + 2])::BIGINT >> j::BIGINT) & 1::BIGINT)))),
         lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) AS h FROM g),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
v AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM w)),
e AS (
  SELECT x.word, y.word AS other, y.n AS m FROM v x JOIN v y ON x.i = y.i AND x.cut = y.cut AND length(x.word) = length(y.word) WHERE x.word <> y.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.cut = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.cut = w.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM e GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN m >= 10 * n THEN (SELECT min(other) FROM e WHERE e.word = w.word AND e.m = b.m) END AS form,
         CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM w LEFT JOIN b ON b.word = w.word),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.next = f.word)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""


@_query("op13_spelling", OP13_SQL)
def op13(spark, sf_dir):
    """Every word of the documents with its more frequent spelling."""
    return spelling_groups(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = r"""
WITH t0 AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT c, tok, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tok) AS k
  FROM (SELECT c, turn, sha256(length(role) || ':' || role || text) AS tok, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t0)),
ids AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x:
           list_transform(range(0, 8), lambda j: (ascii(x)::BIGINT >> j::BIGINT) & 1::BIGINT)))),
         lambda a, x: xor(a >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t0)),
r AS (SELECT ids.c, 0 AS part, k, tok, words FROM ids JOIN t ON t.c = base WHERE k <= h
      UNION ALL SELECT ids.c, 1, k, tok, words FROM ids JOIN t ON t.c = ids.c WHERE k > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, tok, words FROM r),
p AS (SELECT c, d, string_agg(tok, '') OVER (PARTITION BY c ORDER BY d) AS pre, words FROM s UNION ALL SELECT c, 0, '', 0 FROM ids),
n AS (SELECT pre, d, min(c) AS conv, count(*) AS n, any_value(words) AS words FROM p GROUP BY pre, d),
k AS (SELECT left(pre, 64 * (d - 1)) AS pre, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (pre)),
o AS (SELECT c, p.d, p.pre, CASE WHEN conv = c THEN (n - 1) * f.words ELSE 0 END AS sv, CASE WHEN conv = c AND kids = 0 THEN 1 ELSE 0 END AS lf FROM p JOIN f USING (pre)),
u AS (SELECT pre, sum(sv) OVER w AS sv, sum(lf) OVER w AS lf FROM o WINDOW w AS (PARTITION BY c ORDER BY d DESC)),
a AS (SELECT pre, sum(sv)::BIGINT AS sv, sum(lf)::BIGINT AS lf FROM u GROUP BY pre),
e AS (SELECT pre, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(pre, d) AS pre FROM p GROUP BY c) GROUP BY pre)
SELECT f.conv AS conv_id, f.d::BIGINT AS depth, q.conv AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, lf AS n_leaves, sv AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN a ON a.pre = f.pre LEFT JOIN e ON e.pre = f.pre LEFT JOIN f q ON f.d > 0 AND q.pre = left(f.pre, 64 * (f.d - 1))
"""


@_query("op12_prefix_trie", OP12_SQL)
def op12(spark, sf_dir):
    """Every shared beginning of the rebuilt conversations."""
    trie = prefix_trie(rebuilt(conversation_turns(table(spark, sf_dir, "conversations"))))
    return trie.drop("node", "parent")


OP11_SQL = OP2_SQL.replace(", 5) - 1) AS g", ", 4) - 1) AS g").replace("least(len(w), 5) + 2", "least(len(w), 4) + 2").replace(
    "component_id FROM d LEFT", "component_id, doc_id = component_id AS kept FROM d LEFT")


@_query("op11_hyperminhash", OP11_SQL)
def op11(spark, sf_dir):
    """Every document's component of links at 80 % of 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
