"""The numbered queries: each applies its operator to whole tables and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import stored, table

WORD_TOKENIZER, WORD_END = "word_bpe_49k.json", 2
BYTE_TOKENIZER, BYTE_END = "byte_bpe_50k.json", 1
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bit_planes import read_ids, write_ids

    segments = write_ids(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), WORD_END)
    return read_ids(segments).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import cut_documents, pack_pieces

    pieces = cut_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), BYTE_END)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(stored(digests, "pieces"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_duplicates import as_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_rows

    texts = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = shard_rows(stored(texts, "sizes"), ["doc_id", "text_crc32"])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import media_features, to_media

    media = stored(to_media(table(spark, sf_dir, "documents")), "media")
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("-", k["start"], k["end"])), ",")
    feature = F.concat_ws(";", F.trim("codec"), F.format_string("%.6f", "duration_s"), F.col("n_samples"), ranges)
    return media_features(media, payload=False).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op7_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.personal_data import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))

    def listed(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import assemble, read_records, write_archives

    captures = assemble(read_records(write_archives(table(spark, sf_dir, "pages"))), payload=False)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix, place_documents, plan_slots, source_targets, text_mark, word_count

    documents = table(spark, sf_dir, "documents")
    sized = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_mark(F.col("text"))), "sizes")
    targets = stored(source_targets(sized), "targets")
    placed = stored(place_documents(sized, targets).withColumn("row", F.monotonically_increasing_id()), "placed")
    taken = mix(placed, plan_slots(targets)).groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    named = placed.join(targets.select(F.col("number").alias("source_number"), "source_size", "target"), "source_number")
    return named.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.conversations import damage, repair, repaired_digests

    found = repaired_digests(repair(damage(table(spark, sf_dir, "conversations"))))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), decode=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("bounds", -1).cast("long").alias("n_bytes"),
        F.xxhash64("bounds").alias("bounds_hash"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_planes": op1_bit_planes,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_simhash": op4_simhash,
    "op5_ring_sharding": op5_ring_sharding,
    "op6_media": op6_media,
    "op7_risk_controlled": op7_risk_controlled,
    "op8_personal_data": op8_personal_data,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversations": op12_conversations,
    "op13_pieces": op13_pieces,
}

_BLANK = r"\x20\x09-\x0D"


def _quality_sql() -> str:
    """The quality rules in DuckDB's SQL, with the binomial terms from logarithms of the gamma function."""
    from tessera.llm.quality import LIMIT, PRICE, RISK, RULES, STEPS

    def first(rule) -> str:
        return (
            f"CASE WHEN {rule.whole} > 0 THEN greatest(0, least({STEPS + 1}, CAST(floor(({rule.high} - {rule.part} / {rule.whole})"
            f" * {STEPS / (rule.high - rule.low)!r}) AS BIGINT) + 1)) END"
        )

    rules = ", ".join(f"{{'rule': '{r.name}', 'first': {first(r)}}}" for r in RULES)
    share, tests = LIMIT / len(RULES), len(RULES)
    return f"""
    WITH texts AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l FROM documents),
    windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
    repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS x(k) GROUP BY r),
    counts AS (
      SELECT r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[{_BLANK}]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM texts LEFT JOIN covered USING (r)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
    ruled AS (SELECT r, stratum, base_failed, doc_id, unnest([{rules}]) AS x FROM judged),
    held AS (
      SELECT stratum, x.rule AS rule, x.first AS first, quality AS good, 1 - quality AS bad
      FROM ruled JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND NOT base_failed),
    sizes AS (SELECT stratum, rule, sum(good) AS n, {tests} * (SELECT count(DISTINCT stratum) FROM held) AS tests FROM held GROUP BY ALL),
    terms AS (SELECT stratum, rule, n, tests, unnest(range(0, CAST(n AS BIGINT) + 1)) AS k FROM sizes),
    sums AS (
      SELECT stratum, rule, k, tests, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({share}) + (n - k) * ln(1 - {share})))
        OVER (PARTITION BY stratum, rule ORDER BY k) AS p FROM terms),
    allowed AS (SELECT stratum, rule, coalesce(max(k) FILTER (WHERE p <= {RISK} / tests), -1) AS most FROM sums GROUP BY ALL),
    grid AS (
      SELECT stratum, rule, step, sum(good) FILTER (WHERE first <= step) AS good, sum(bad) FILTER (WHERE first <= step) AS bad
      FROM held, range(0, {STEPS + 1}) AS s(step) GROUP BY ALL),
    gains AS (SELECT stratum, rule, step, coalesce(good, 0) AS wrong, coalesce(bad, 0) - {PRICE} * coalesce(good, 0) AS gain FROM grid),
    chosen AS (
      SELECT stratum, rule, step FROM gains JOIN allowed USING (stratum, rule) WHERE wrong <= most AND gain > 0
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
    rejected AS (SELECT DISTINCT r FROM ruled JOIN chosen ON chosen.stratum = ruled.stratum AND chosen.rule = ruled.x.rule WHERE x.first <= step)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND rejected.r IS NULL AS kept
    FROM judged LEFT JOIN rejected USING (r)"""


def _conversations_sql() -> str:
    """Damage, marks, costs from the back, edits from the front and the replay in DuckDB's SQL."""
    checksum = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(x AS BIGINT) FOR x IN [0, 0, 0, 0, 0, 0, 0, 0]]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT))"""
    ahead = "[2, 2, 3, 2][state + 1]"
    return f"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
    kinds AS (SELECT *, {checksum} % 20 AS d FROM keyed),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE d WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE d <> 0),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM damaged),
    marked AS (
      SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair,
        CASE WHEN NOT regexp_matches(text, '[^{_BLANK}]') THEN 'b' WHEN seen > 1 THEN 'd'
          WHEN NOT regexp_matches(text, '[.!?][{_BLANK}]*$') THEN 't' ELSE '-' END AS fault FROM placed),
    signed AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
        count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
        string_agg(CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN upper(initial) ELSE initial END, '' ORDER BY pos) AS sig
      FROM marked GROUP BY conv_id),
    sigs AS (SELECT DISTINCT sig FROM signed),
    costs AS (
      SELECT sig, length(sig) AS pos, [0, 6, 3, 0] AS c FROM sigs
      UNION ALL
      SELECT sig, pos - 1, [least(o[1], 3 + o[3], 6 + o[4]), least(o[2], 3 + o[3], 6 + o[4]), least(o[3], 3 + o[4]), least(o[4], 3 + o[3])]
      FROM (
        SELECT sig, pos, [least(4 + c[1], CASE WHEN x <> 'x' THEN t + 3 + c[3] END, CASE x WHEN 's' THEN t + c[2] WHEN 'u' THEN t + c[3] END),
          least(4 + c[2], CASE WHEN x <> 'x' THEN t + 3 + c[3] END, CASE WHEN x = 'u' THEN t + c[3] END),
          least(4 + c[3], CASE WHEN x <> 'x' THEN t + 3 + c[4] END, CASE WHEN x = 'a' THEN t + c[4] END),
          least(4 + c[4], CASE WHEN x <> 'x' THEN t + 3 + c[3] END, CASE WHEN x = 'u' THEN t + c[3] END)] AS o
        FROM (SELECT sig, pos, c, lower(substr(sig, pos, 1)) AS x, CASE WHEN substr(sig, pos, 1) BETWEEN 'A' AND 'Z' THEN 3 ELSE 0 END AS t FROM costs WHERE pos > 0))),
    steps AS (
      SELECT sig, 0 AS step, 0 AS pos, 0 AS state, c[1] AS rest, '' AS letter, '' AS audit FROM costs WHERE pos = 0
      UNION ALL
      SELECT sig, step + 1, CASE letter WHEN 'I' THEN pos ELSE pos + 1 END,
        CASE letter WHEN 'D' THEN state WHEN 'K' THEN keeps ELSE ahead END,
        rest - CASE letter WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN t ELSE t + 3 END, letter, audit || letter
      FROM (
        SELECT *, CASE WHEN 4 + following[state + 1] = rest THEN 'D' WHEN 3 + current_costs[ahead + 1] = rest THEN 'I'
          WHEN t + following[keeps + 1] = rest THEN 'K' WHEN x <> 'x' AND t + 3 + following[ahead + 1] = rest THEN 'R' END AS letter
        FROM (
          SELECT s.sig, s.step, s.pos, s.state, s.rest, s.audit, a.c AS current_costs, b.c AS following, {ahead} AS ahead, lower(substr(s.sig, s.pos + 1, 1)) AS x,
            CASE WHEN substr(s.sig, s.pos + 1, 1) BETWEEN 'A' AND 'Z' THEN 3 ELSE 0 END AS t,
            CASE WHEN x = 's' AND state = 0 THEN 1 WHEN x = 'u' AND state <> 2 THEN 2 WHEN x = 'a' AND state = 2 THEN 3 END AS keeps
          FROM steps s JOIN costs a ON a.sig = s.sig AND a.pos = s.pos LEFT JOIN costs b ON b.sig = s.sig AND b.pos = s.pos + 1))
      WHERE letter IS NOT NULL),
    solved AS (SELECT sig, max_by(audit, step) AS audit FROM steps GROUP BY sig),
    totals AS (SELECT sig, c[1] AS cost FROM costs WHERE pos = 0),
    replayed AS (
      SELECT signed.conv_id, string_agg(CASE letter WHEN 'K' THEN role || ':' || text ELSE ['user', 'assistant'][state - 1] || ':' || CASE letter WHEN 'R' THEN text ELSE '' END END,
        chr(10) ORDER BY step) AS body
      FROM signed JOIN steps ON signed.sig = steps.sig LEFT JOIN marked ON marked.conv_id IS NOT DISTINCT FROM signed.conv_id AND marked.pos = steps.pos
      WHERE letter IN ('I', 'K', 'R') GROUP BY signed.conv_id)
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN signed ON signed.conv_id IS NOT DISTINCT FROM c.conv_id
      LEFT JOIN solved USING (sig) LEFT JOIN totals USING (sig) LEFT JOIN replayed ON replayed.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op12_conversations": _conversations_sql(),
    "op7_risk_controlled": _quality_sql(),
    "op11_filter_audit": f"""
    WITH marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    texts AS (
      SELECT coalesce(lang, '') AS part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w,
        doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copied FROM documents LEFT JOIN marks USING (doc_id)),
    failed AS (
      SELECT part, good, toxic,
        concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
          CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN copied THEN 'E' END) AS failed FROM texts),
    masks AS (SELECT *, count(*) AS n FROM failed GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
      SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    placed AS (
      SELECT *, substr(filter_order, step, 1) AS own, translate(left(filter_order, step - 1), failed, '') <> left(filter_order, step - 1) AS gone
      FROM masks, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    steps AS (SELECT *, contains(failed, own) AS fails FROM placed),
    counted AS (
      SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(sum(CASE WHEN gone OR fails THEN 0 ELSE n END) AS BIGINT) AS kept,
        CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(sum(CASE WHEN failed = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM steps GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted""",
    "op9_warc": """
    WITH payloads AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts""",
}
