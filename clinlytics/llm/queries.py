"""The registered queries of the corpus operators and their SQL."""
from __future__ import annotations

from clinlytics.llm import (chat_format, collocations, decontaminate, html_extract, lang_id, licenses, mixing, near_dedup, periodic_runs, pii, pivot_index,
                            quality, secret_scan)
from clinlytics.llm.common import table

QUERIES = {
    "op1_compression_quality": lambda spark, d: quality.quality_report(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_pii_disclosure": lambda spark, d: pii.detect(table(spark, d, "documents")),
    "op3_secret_guess_cost": lambda spark, d: secret_scan.scan(table(spark, d, "documents")),
    "op4_license_digest": lambda spark, d: licenses.scan(table(spark, d, "documents")),
    "op5_hierarchical_mixing": lambda spark, d: mixing.mixture(table(spark, d, "documents")),
    "op6_pivot_near_vectors": lambda spark, d: pivot_index.link_vectors(table(spark, d, "embeddings")),
    "op7_template_extraction": lambda spark, d: html_extract.extract(table(spark, d, "pages")),
    "op8_positional_decontamination": lambda spark, d: decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_oph_near_documents": lambda spark, d: near_dedup.deduplicate(table(spark, d, "documents")),
    "op10_kneser_ney_language": lambda spark, d: lang_id.language_report(table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: periodic_runs.report(table(spark, d, "documents")),
    "op12_chat_turns": lambda spark, d: chat_format.report(table(spark, d, "conversations")),
    "op13_debruijn_collocations": lambda spark, d: collocations.collocations(table(spark, d, "documents")),
}

_COMPONENTS = """
    reach AS (SELECT id, id AS other FROM node UNION SELECT r.id, e.v FROM reach r JOIN both_ e ON r.other = e.u),
    part AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

_OP6 = f"""
    WITH RECURSIVE node AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
    unit AS (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM node
             WHERE label IS NOT NULL AND e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0),
    both_ AS (SELECT a.id AS u, b.id AS v FROM unit a JOIN unit b ON a.label = b.label AND a.id <> b.id
              WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {pivot_index.COSINE}),
    n AS (SELECT u AS id, count(*) AS n FROM both_ GROUP BY u), {_COMPONENTS}
    SELECT node.id AS vec_id, coalesce(n, 0) AS n_links, component_id, node.id = component_id AS kept
    FROM node LEFT JOIN n USING (id) JOIN part USING (id)"""

_OP9 = f"""
    WITH RECURSIVE node AS (SELECT doc_id AS id, regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingle AS (SELECT DISTINCT id, hash(s) AS h FROM (SELECT id, array_to_string(w[i:i + 4], ' ') AS s
                FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM node WHERE len(w) > 0))),
    size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
    common AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM shingle a JOIN shingle b ON a.h = b.h AND a.id <> b.id GROUP BY a.id, b.id),
    both_ AS (SELECT u, v FROM common JOIN size x ON x.id = u JOIN size y ON y.id = v WHERE 100 * k >= 75 * (x.n + y.n - k)), {_COMPONENTS}
    SELECT node.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node.id = component_id AS kept
    FROM node LEFT JOIN size USING (id) JOIN part USING (id)"""

ORACLES = {
    "op4_license_digest": licenses.oracle(),
    "op5_hierarchical_mixing": mixing.oracle(),
    "op6_pivot_near_vectors": _OP6,
    "op8_positional_decontamination": decontaminate.oracle(),
    "op9_oph_near_documents": _OP9,
    "op12_chat_turns": chat_format.oracle(),
    "op13_debruijn_collocations": collocations.oracle(),
}
