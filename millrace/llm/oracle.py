"""DuckDB SQL equal to the queries of this subpackage that SQL can express."""

from __future__ import annotations

_TERM = "trim(lower(token), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(12288) || '.,?:;()''\"[]<>')"
_PAIRS = f"""
valid AS (SELECT DISTINCT row_id, docno, {_TERM} AS term, tf FROM nb WHERE docno IS NOT NULL AND tf > 0 AND {_TERM} <> ''),
pairs AS (SELECT docno, term, sum(tf) AS tf FROM valid GROUP BY docno, term),
n AS (SELECT count(DISTINCT docno) AS records FROM pairs),
terms AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS df FROM pairs GROUP BY term),
marked AS (SELECT term, occurrences, df, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.4 * records THEN 'common' END AS mark FROM terms, n)
"""
_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_REPORT = f"""
labels AS (SELECT DISTINCT docno, {_KEY.format("cat")} AS label FROM nb WHERE docno IS NOT NULL AND cat IS NOT NULL),
n AS (SELECT count(DISTINCT docno) AS records FROM labels),
have AS (SELECT label, count(*) AS available FROM labels GROUP BY label),
report AS (SELECT cat, CAST(greatest(min_docs, round(target_share * (0.5 * records))) AS BIGINT) AS quota, coalesce(available, 0) AS available
           FROM cat_targets CROSS JOIN n LEFT JOIN have ON label = {_KEY.format("cat")})
"""

ORACLE = {
    "p1_found": f"WITH {_PAIRS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_frequencies": f"WITH {_PAIRS} SELECT term, occurrences, df, mark FROM marked",
    "p2_found": f"WITH {_REPORT} SELECT cat FROM report WHERE available < quota",
    "p2_report": f"WITH {_REPORT} SELECT cat, quota, available, least(quota, available) AS sampled, greatest(quota - available, 0) AS gap FROM report",
    "p3_found": f"""WITH {_PAIRS}, totals AS (SELECT docno, sum(tf) AS total FROM pairs GROUP BY docno)
        SELECT p.docno, p.term FROM pairs p JOIN totals USING (docno) JOIN terms t ON t.term = p.term, n
        WHERE p.tf * 5 >= total AND df >= 2 AND df * 50 <= records""",
}
