"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact, langid, lines, neardup, periodic, phrases, secrets, suffix, toxicity, vectors
from .registry import ORACLES, QUERIES, query  # noqa: F401


@query("op1_suffix_dedup")
def _(t):
    cut = suffix.remove_repeats(t("documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def fold(of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


@query("op2_toxicity")
def _(t):
    docs = t("documents").select("doc_id", "text")
    model = toxicity.train(docs, t("labels").filter(fold(5) != 0).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


@query("op3_byte_bpe")
def _(t):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    done = bpe.encode(t("documents"), ranks, public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"),
    )


@query(
    "op4_chat_format",
    """WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
       placed AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS total,
                         string_agg(md5(role || chr(1) || text), ',') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
                  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
       whole AS (SELECT prefix, min(conv_id) AS conv_id, max(total) AS n_turns, count(*) AS n_copies FROM placed WHERE pos = total GROUP BY prefix),
       kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM placed WHERE pos < total))
       SELECT k.conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_copies,
              string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
       FROM kept k JOIN placed p ON k.conv_id = p.conv_id GROUP BY ALL""",
)
def _(t):
    return chat.format_conversations(t("conversations"))


@query("op5_language")
def _(t):
    docs = t("documents")
    held_out = fold(4) == 2
    dictionaries = langid.train_dictionaries(docs, ~held_out & F.col("lang").isNotNull())
    # The id alone says which rows were held out; it is not an input of the prediction.
    return langid.predict_language(docs, dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_decontaminate")
def _(t):
    return decontaminate.find_leaks(t("documents"), t("benchmark"))


@query("op7_minhash")
def _(t):
    # By id, as asked: rows that share an id are told apart by the operator's own ``kept``.
    return neardup.group_near_copies(t("documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op8_secrets")
def _(t):
    found = secrets.find_secrets(t("documents"))
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in ("assign", "access", "hex")]
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = listed(F.filter("found", lambda s: s["base"]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


@query(
    "op9_line_dedup",
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
       w AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM l),
       f AS (SELECT *, pair IS NOT NULL AND row_number() OVER (PARTITION BY pair ORDER BY doc_id, pos) > 1 AS dup FROM w),
       g AS (SELECT *, dup OR coalesce(lag(dup) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM f),
       h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM g)
       SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
              sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
       FROM h GROUP BY doc_id""",
)
def _(t):
    return cut_lines(lines.drop_repeated_lines(t("documents")))


def cut_lines(cut):
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_runs"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op9_long_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
       w AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS pair,
                    len(regexp_extract_all(line, '[^\\x09-\\x0D ]+')) > 50 AS long FROM l),
       f AS (SELECT *, pair IS NOT NULL AND row_number() OVER (PARTITION BY pair ORDER BY doc_id, pos) > 1 AS dup,
                    long AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS alone FROM w),
       g AS (SELECT *, dup OR alone OR coalesce(lag(dup) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM f),
       h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM g)
       SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs,
              sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
       FROM h GROUP BY doc_id""",
)
def _(t):
    return cut_lines(lines.drop_repeated_lines(t("documents"), alone=lines.LONG))


@query(
    "op10_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
              sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def _(t):
    return exact.label_copies(t("documents"), keep="max")


def planted(docs):
    """``documents`` with the periodic stretches that the contract of op11 puts into every tenth of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("w"))
    docs = docs.select("*", F.size("w").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    docs = docs.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    cycle = "flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int)))"
    return docs.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join(slice(concat(slice(w, 1, a), {cycle}), 1, n), ' ')")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def _(t):
    found = periodic.find_runs(planted(t("documents")))
    # Greatest length / period first, compared by cross products; then by start and period.
    found = found.withColumn("best", F.expr("""array_sort(runs, (x, y) -> case
        when x.length * y.period <> y.length * x.period then if(x.length * y.period > y.length * x.period, -1, 1)
        when x.start <> y.start then if(x.start < y.start, -1, 1) else int(signum(x.period - y.period)) end)"""))
    best = F.get("best", F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * get(best, 0).length div get(best, 0).period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_embedding_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
       links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
       reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
       SELECT vec_id, coalesce((SELECT count(*) FROM links WHERE a = vec_id), 0) AS n_links,
              coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS component_id,
              vec_id = coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept FROM embeddings""",
)
def _(t):
    return vectors.group_near_vectors(t("embeddings"))


@query(
    "op13_collocations",
    """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
       words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
       total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
       grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
                 FROM words, range(1, 5) AS r(k) WHERE len(w) >= k),
       f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
       cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
       split AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
                 FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
       cuts AS (SELECT s.lang, s.phrase, a, j, l.f AS l, r.f AS r, (2000000 * a::HUGEINT) // (l.f + r.f) AS score
                FROM split s JOIN f l ON l.lang = s.lang AND l.phrase = s.first JOIN f r ON r.lang = s.lang AND r.phrase = s.rest),
       least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
       held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
                FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
       kept AS (SELECT s.* FROM least s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase WHERE h.most IS NULL OR 100 * h.most::HUGEINT < 80 * s.a::HUGEINT)
       SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
       FROM kept k JOIN total t ON t.lang = k.lang QUALIFY rank <= 2000""",
)
def _(t):
    return phrases.collocations(t("documents"))
