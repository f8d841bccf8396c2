"""The registered queries of this folder's operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.llm.sampling import fold
from braidlog.llm.tables import table


def held_out(folds: int, fold_no: int) -> Column:
    """Whether a row is outside what may be learned from; false without a doc_id."""
    return F.coalesce(fold(F.col("doc_id"), folds) == fold_no, F.lit(False)).alias("held_out")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.line_dedup import drop_common_lines

    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.secrets import find_secrets, labelled_sample, train

    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), train(labelled_sample(spark)))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import quality as q
    from braidlog.llm.sampling import labelled

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled(docs, table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), 5) != 0, per_class=600)
    out = q.quality(docs, q.train(sample), threshold=0.3)
    return out.select("doc_id", held_out(5, 0), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.language_id import Model, identify, sample_of

    docs = table(spark, sf_dir, "documents")
    model = Model(sample_of(docs, fold(F.col("doc_id"), 3) != 1))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(3, 1), "lang_pred", "score")


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read by the driver; operators send its content to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode(), end=2, size=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm import toxicity as t
    from braidlog.llm.sampling import labelled

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = labelled(docs, table(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 5) != 0, per_class=1500)
    out = t.toxicity(docs, t.train(sample), threshold=0.5)
    return out.select("doc_id", held_out(5, 0), "score", "predicted")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"), shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")


def conversation_rolls() -> Column:
    """crc32 of `conv_id:turn` modulo 20, a space for null."""
    return F.pmod(F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")), F.lit(20))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.conversations import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations"), conversation_rolls()))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.merkle import manifest

    tampered = F.when(fold(F.col("doc_id"), 3) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return manifest(table(spark, sf_dir, "documents"), tampered).drop("proof")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_top_k": op3_top_k,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_ngram_join": op11_ngram_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _links_sql(shingle: int, percent: int, columns: str) -> str:
    """Components of documents by links of their shingle sets, over all pairs that share a shingle."""
    return rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) < {shingle} THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
                   ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i : i + {shingle - 1}], ' '))) END AS s FROM words
        ), shingles AS (
            SELECT doc_id, unnest(s) AS shingle FROM sets
        ), both_in AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM both_in JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * common >= {percent} * (len(x.s) + len(y.s) - common)
        ), edges AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT doc_id, doc_id FROM sets
        ), reach AS (
            SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, {columns} FROM sets JOIN least USING (doc_id)
    """


def _manifest_sql() -> str:
    leaf = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _crc32_sql("CAST(doc_id AS VARCHAR)")
    step = "SELECT tree, level + 1 AS level, place // 8 AS place, (n + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {0} WHERE n > 1 GROUP BY tree, level, place // 8, n"
    steps = """
        SELECT o.{0}, s.level, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < o.place // (8 ** s.level)::BIGINT), '') AS "left", coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > o.place // (8 ** s.level)::BIGINT), '') AS "right"
        FROM {1} o JOIN {2} s ON o.tree = s.tree AND s.n > 1 AND s.place // 8 = o.place // (8 ** s.level)::BIGINT // 8 GROUP BY ALL"""
    return rf"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf.format(text="text")} AS leaf, CASE WHEN {crc} % 3 = 0 AND text IS NOT NULL THEN {leaf.format(text=lowered)} END AS other FROM documents
        ), placed AS (
            SELECT *, row_number() OVER () AS id FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves)
        ), nodes AS (
            SELECT tree, 0 AS level, place, n, leaf AS digest FROM placed UNION ALL {step.format("nodes")}
        ), langs AS (
            SELECT tree AS of, '2' AS tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
        ), top AS (
            SELECT tree, 0 AS level, place, n, subroot AS digest FROM langs UNION ALL {step.format("top")}
        ), root AS (
            SELECT digest AS root FROM top WHERE n = 1
        ), low_steps AS ({steps.format("id", "placed", "nodes")}
        ), top_steps AS ({steps.format("of", "langs", "top")}
        ), steps AS (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY high, level) AS k
            FROM (SELECT id, 0 AS high, level, "left", "right" FROM low_steps UNION ALL SELECT id, 1, level, "left", "right" FROM placed p JOIN top_steps t ON p.tree = t.of)
        ), folded AS (
            SELECT id, 0 AS k, coalesce(other, leaf) AS acc FROM placed
            UNION ALL SELECT f.id, s.k, sha256(s."left" || f.acc || s."right") FROM folded f JOIN steps s ON s.id = f.id AND s.k = f.k + 1
        ), proofs AS (
            SELECT p.id, sha256(coalesce(string_agg(s."left" || s."right", '' ORDER BY s.k), '')) AS proof_sha256 FROM placed p LEFT JOIN steps s USING (id) GROUP BY p.id
        ), ends AS (
            SELECT id, arg_max(acc, k) AS folded_root FROM folded GROUP BY id
        )
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
        FROM placed p JOIN langs l ON p.tree = l.of CROSS JOIN root JOIN proofs USING (id) JOIN ends USING (id)
    """


def _repair_sql() -> str:
    """The dynamic program row by row; a state is its cost in eight digits and its audit, so that the least text is the best."""
    add = lambda v, cost, letter: f"(lpad(CAST(CAST(left({v}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({v}, 9) || '{letter}')"
    best = lambda *x: f"least({', '.join(x)})"
    when = lambda test, v: f"CASE WHEN {test} THEN {v} END"
    gone, keeps = "fault IS NOT DISTINCT FROM 'blank' OR fault IS NOT DISTINCT FROM 'duplicate'", "NOT gone AND h = '{0}'"
    moves = lambda role, froms: [when(keeps.format(role), add(f, "more", "K")) for f in froms] + ([when("NOT gone", add(f, "more + 1", "R")) for f in froms] if role != "s" else [])
    to_user = ("v0", "v1", "v3")
    after = [add("v0", 2, "D"), best(add("v1", 2, "D"), *moves("s", ["v0"])), best(add("v2", 2, "D"), *moves("u", to_user)), best(add("v3", 2, "D"), *moves("a", ["v2"]))]
    order = "turn NULLS FIRST, tie, copy"
    roll = _crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    return rf"""
        WITH RECURSIVE rolled AS (
            SELECT coalesce('1' || conv_id, '0') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, sha256(coalesce(role, ' ') || chr(0) || coalesce(text, ' ')) AS tie, {roll} % 20 AS roll FROM conversations
        ), hit AS (
            SELECT key, turn, tie, CASE WHEN roll = 4 THEN 'user' ELSE role END AS role, CASE roll WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE roll WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM rolled
        ), ordered AS (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS i, row_number() OVER (PARTITION BY key, role, text ORDER BY {order}) AS nth,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS h FROM hit
        ), faulty AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(h) OVER (PARTITION BY key ORDER BY i) AS before FROM ordered
        ), turns AS (
            SELECT *, {gone} AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM faulty
        ), summed AS (
            SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (i > 1 AND before || h NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY key
        ), raw AS (
            SELECT key, 0 AS i, '00000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '00000005I' AS v2, '00000010II' AS v3 FROM summed
            UNION ALL
            SELECT key, i, w0, w1, u, least(w3, {add("u", 5, "I")}) FROM (
                SELECT *, least(w2, {", ".join(add(w, 5, "I") for w in ("w0", "w1", "w3"))}) AS u FROM (
                    SELECT t.key, t.i, {", ".join(f"{x} AS w{k}" for k, x in enumerate(after))} FROM raw r JOIN turns t ON t.key = r.key AND t.i = r.i + 1))
        ), best AS (
            SELECT key, CAST(left(v, 8) AS BIGINT) AS cost, substr(v, 9) AS audit FROM (SELECT key, least(v0, v3) AS v FROM raw JOIN summed USING (key) WHERE i = n)
        ), letters AS (
            SELECT key, generate_subscripts(string_split(audit, ''), 1) AS k, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''
        ), edits AS (
            SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY key ORDER BY k) AS i FROM letters
        ), kept AS (
            SELECT e.key, k, letter, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, h, row_number() OVER (PARTITION BY e.key ORDER BY k) - 1 AS j FROM edits e LEFT JOIN turns t ON t.key = e.key AND t.i = e.i WHERE letter <> 'D'
        ), led AS (
            SELECT *, max(CASE WHEN j = 0 AND letter = 'K' AND h = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS lead FROM kept
        ), texts AS (
            SELECT key, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j + lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS repaired FROM led GROUP BY key
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce('1' || conv_id, '0') AS key FROM conversations) LEFT JOIN summed USING (key) LEFT JOIN best USING (key) LEFT JOIN texts USING (key)
    """


def _crc32_sql(text: str) -> str:
    """crc32 of the bytes of `text`: of each byte in turn eight steps of the polynomial's division."""
    step = "lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(range(8), {step}, xor(c, ascii(b)))"
    return f"xor(list_reduce(string_split({text}, ''), lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


ORACLES = {
    "op1_line_dedup": r"""
        WITH parts AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM parts
        ), common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (c.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key
        GROUP BY doc_id
    """,
    "op3_top_k": r"""
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 20
    """,
    "op4_near_dedup": _links_sql(2, 80, "component_id, doc_id = component_id AS kept"),
    "op11_ngram_join": _links_sql(4, 85, "component_id"),
    "op12_conversation_repair": _repair_sql(),
    "op13_merkle_manifest": _manifest_sql(),
    "op7_decontamination": r"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS body
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
        ), sizes AS (
            SELECT DISTINCT n FROM windows
        ), runs AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS body
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
        ), hits AS (
            SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, body)
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
}
