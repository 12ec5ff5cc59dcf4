"""The registered queries of the ten operators and their SQL, where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentflow.llm import ann, bpe, chat, collocations, decontaminate, embed_dedup, langid, lexical_search, packing, secret_scan, simhash, toxicity, url_filter
from segmentflow.llm.columns import column
from segmentflow.session import table

URL_RULES = """
    SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
        ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    AS rules(host, path, verdict)
"""
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["rank"] < len(secret_scan.BASE))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    windows = chat.format_windows(talks.unionByName(control))
    read = chat.read_windows(windows)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return packed_pieces(packing.pack(table(spark, sf_dir, "documents"), path, pattern))


def packed_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def fold_of(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(column(id_col).cast("string").cast("binary")), F.lit(folds))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0, k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 3) == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, most_words=5, absorbed=100, k=2000)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_chat": op3_chat,
    "op4_embeddings": op4_embeddings,
    "op5_urls": op5_urls,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_neighbours": op8_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
    "op11_phrases": op11_phrases,
    "op12_decontaminate": op12_decontaminate,
    "op13_search": op13_search,
}

ORACLE_SQL = {
    "op4_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id
              WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach AS (SELECT vec_id AS s, vec_id AS d FROM v UNION SELECT r.s, l.d FROM reach r JOIN l ON r.d = l.s),
        named AS (SELECT s AS vec_id, min(d) AS component_id FROM reach GROUP BY s),
        counted AS (SELECT s AS vec_id, count(*) AS n FROM l GROUP BY s)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM named LEFT JOIN counted USING (vec_id)
    """,
    "op5_urls": """
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
            FROM pages),
        rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
            ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fits AS (
            SELECT s.*, h || p AS rule, v,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS n
            FROM parts s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE n = 1
    """,
    "op11_phrases": r"""
        WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS own
                   FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                         FROM documents)),
        o AS (SELECT lang, own, unnest(range(1, len(own) + 1)) AS pos FROM p),
        f AS (SELECT lang, size, array_to_string(own[pos:pos + size - 1], ' ') AS phrase, count(*) AS f
              FROM o, (SELECT unnest(range(1, 6)) AS size) WHERE pos + size - 1 <= len(own) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 100),
        k AS (SELECT lang, size, phrase, c.f AS a, w, unnest(range(1, size)) AS k FROM c),
        s AS (SELECT lang, k.phrase, k.size, a, k.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
              FROM k JOIN n USING (lang)
              JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k.k], ' ') AND x.size = k.k
              JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k.k + 1:], ' ') AND y.size = k.size - k.k),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM s),
        d AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND y.size > x.size
              AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.f >= 100 * x.f)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
              FROM b ANTI JOIN d USING (lang, phrase) WHERE cut = 1)
        WHERE rank <= 2000
    """,
    "op12_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM benchmark),
        t AS (SELECT DISTINCT item_id, least(len(own), 10) AS size,
                  array_to_string(own[pos:pos + least(len(own), 10) - 1], ' ') AS shown
              FROM (SELECT *, unnest(range(1, greatest(len(own) - 9, 1) + 1)) AS pos FROM i WHERE len(own) > 0)),
        p AS (SELECT doc_id, own, unnest(range(1, len(own) + 1)) AS pos FROM w),
        h AS (SELECT doc_id, pos, s.size, item_id
              FROM (SELECT doc_id, pos, size, array_to_string(own[pos:pos + size - 1], ' ') AS shown
                    FROM p, (SELECT DISTINCT size FROM t) WHERE pos + size - 1 <= len(own)) s
              JOIN t USING (size, shown)),
        c AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM h) GROUP BY doc_id),
        g AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
              FROM h GROUP BY doc_id)
        SELECT doc_id, coalesce(len(own), 0)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(g.n, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
    """,
    "op13_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        i AS (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        dt AS (SELECT doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
               FROM d GROUP BY ALL),
        it AS (SELECT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times
               FROM i GROUP BY ALL),
        ns AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM dt GROUP BY doc_id),
        g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM ns),
        m AS (SELECT doc_id, 75 + (25 * n * big_n) // big_l AS m FROM ns, g),
        w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM dt, g GROUP BY term, big_n),
        s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM it JOIN dt USING (term) JOIN m USING (doc_id) JOIN w USING (term) GROUP BY ALL)
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        WHERE rank <= 20
    """,
}
