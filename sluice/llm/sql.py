"""DuckDB SQL for the corpus operators that SQL can express, over whole tables."""

from __future__ import annotations

_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0),
)


def secrets() -> str:
    """Matches and the pieces between them give the places; matches that are too short drop out."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(_KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(t, '{p}') AS between, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {group}) AS held FROM texts")
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), matches AS ({" UNION ALL ".join(parts)}),
 each AS (SELECT doc_id, kind, rank, least, between, found, held, unnest(range(1, len(found) + 1)) AS i FROM matches),
 spans AS (SELECT doc_id, kind, rank, CAST(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[i]) AS n
 FROM each WHERE length(held[i]) >= least),
 listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) FILTER (kind <> 'pem'), '') AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS spans FROM spans GROUP BY 1)
 SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, false AS scanned
 FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id"""


REPEATS = r"""WITH texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
 windows AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS said FROM texts, unnest(range(1, len(words) - 18)) u(i)),
 ordered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) AS nth FROM windows),
 gone AS (SELECT DISTINCT doc_id, p FROM ordered, unnest(range(i, i + 20)) u(p) WHERE nth > 1),
 each AS (SELECT t.doc_id, p, words[p] AS word FROM texts t, unnest(range(1, len(words) + 1)) u(p)),
 kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS said FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
 SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id"""
