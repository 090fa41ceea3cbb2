"""Registered queries of simulated variants of all types and of their truth files, with DuckDB SQL."""

from __future__ import annotations

from ..operators import simulate
from .adapters import SEQS_SQL, seqs
from .queries import RATES, VARIANTS_SQL, WANTED, _draw_sql
from .registry import query


@query(f"WITH {VARIANTS_SQL} SELECT seq_idx, CAST(sv_id AS BIGINT) AS sv_id, sv_type, kind, start, CAST(len AS BIGINT) AS len, str_value FROM ve")
def sv_all_edits(spark, sf_dir):
    """The edits of all eleven types, small and large."""
    reference = seqs(spark, sf_dir)
    return simulate.variant_edits(simulate.place_variants(reference, WANTED), reference)


SIM_SQL = """od AS (SELECT *, coalesce(lag(start + len) OVER (PARTITION BY seq_idx ORDER BY start, len), 0) AS since FROM ve),
sim AS (SELECT s.seq_idx, coalesce(string_agg(substr(seq, CAST(since + 1 AS INT), CAST(start - since AS INT)) || str_value, '' ORDER BY start, len), '') || substr(any_value(seq), CAST(coalesce(max(start + len), 0) + 1 AS INT)) AS sim FROM seqs s LEFT JOIN od ON od.seq_idx = s.seq_idx GROUP BY s.seq_idx)"""


@query(f"WITH {VARIANTS_SQL}, {SIM_SQL} SELECT seq_idx, sim AS seq FROM sim")
def sv_simulated(spark, sf_dir):
    """Every sequence with the edits of all eleven types."""
    reference = seqs(spark, sf_dir)
    return simulate.apply_edits(reference, simulate.variant_edits(simulate.place_variants(reference, WANTED), reference))


#: All eleven types: chance at a position, length.
EVERY_RATE = {simulate.SMALL_DELETE: (0.001, 1), simulate.BIG_INSERT: (0.0005, 20), simulate.DISPERSED: (0.0005, 20), simulate.INVERTED_DUPLICATION: (0.0005, 20), simulate.INVERTED_TRANSLOCATION: (0.0005, 20)} | RATES


@query(f"""WITH RECURSIVE {SEQS_SQL}, p AS (SELECT seq_idx, length(seq) AS total, unnest(range(length(seq))) AS pos FROM seqs),
k AS (SELECT *, CASE {' '.join(f"WHEN {_draw_sql('seq_idx + 1', 'pos', i)} < {int(c * 2**31)} THEN {t}" for i, (t, (c, _)) in enumerate(EVERY_RATE.items(), 20))} END AS sv_type FROM p),
n AS (SELECT *, CASE sv_type {' '.join(f'WHEN {t} THEN {n}' for t, (_, n) in EVERY_RATE.items())} END AS len FROM k WHERE sv_type IS NOT NULL),
w AS MATERIALIZED (SELECT * FROM (SELECT *, pos + CASE WHEN sv_type IN (7, 9, 61, 62) THEN 2 * (len + 1) ELSE len + 1 END AS stop FROM n) WHERE stop <= total),
f AS (SELECT seq_idx, pos, stop, sv_type, len FROM w QUALIFY row_number() OVER (PARTITION BY seq_idx ORDER BY pos) = 1
  UNION ALL SELECT w.seq_idx, w.pos, w.stop, w.sv_type, w.len FROM f JOIN w ON w.seq_idx = f.seq_idx AND w.pos >= f.stop QUALIFY row_number() OVER (PARTITION BY w.seq_idx ORDER BY w.pos) = 1)
SELECT seq_idx, row_number() OVER (PARTITION BY seq_idx ORDER BY pos) - 1 AS sv_id, sv_type, pos AS a_index, CAST(len AS BIGINT) AS len, pos + len + 1 AS b_site FROM f""")
def sv_by_every_rate(spark, sf_dir):
    """Variants of all eleven types by their rates."""
    return simulate.variants_by_rate(seqs(spark, sf_dir), EVERY_RATE)


@query()
def sv_allocated(spark, sf_dir):
    """Variants of all eleven types wherever there is room, the first types first."""
    return simulate.allocated_variants(seqs(spark, sf_dir), WANTED)


THREE_SQL = VARIANTS_SQL.replace("WHEN sv_type IN (9, 62) THEN turned ELSE part END", "WHEN sv_type IN (9, 62) THEN turned WHEN sv_type = 6 THEN part || part ELSE part END")


@query(f"""WITH {THREE_SQL}, {SIM_SQL},
put AS (SELECT e.*, v.a_index, v.len AS a_len, seq, sim, length(str_value) AS n, e.start + (SELECT sum(CASE WHEN o.kind = 'INSERT' AND o.start <= e.start THEN length(o.str_value) WHEN o.kind = 'EXCHANGE' AND o.start < e.start THEN length(o.str_value) - o.len ELSE 0 END) FROM ve o WHERE o.seq_idx = e.seq_idx)
    - CASE WHEN e.kind = 'INSERT' THEN length(str_value) ELSE 0 END AS b
  FROM ve e JOIN va v ON v.seq_idx = e.seq_idx AND v.sv_id = e.sv_id JOIN seqs ON seqs.seq_idx = e.seq_idx JOIN sim ON sim.seq_idx = e.seq_idx WHERE e.sv_type > 5 AND str_value <> ''),
cp AS (SELECT *, n // c AS m, unnest(range(c)) AS copy FROM (SELECT *, CASE WHEN sv_type = 6 THEN n // a_len ELSE 1 END AS c FROM put)),
bl AS (SELECT *, b + copy * m AS bpos, substr(str_value, CAST(copy * m + 1 AS INT), CAST(m AS INT)) AS v, sv_type IN (8, 9, 62) AS minus FROM cp),
od2 AS (SELECT *, row_number() OVER (PARTITION BY seq_idx ORDER BY a_index, bpos, sv_id) - 1 AS ord, CASE WHEN minus THEN length(sim) - bpos - m ELSE bpos END AS put_at, CASE WHEN minus THEN '-' ELSE '+' END AS strand FROM bl)
SELECT seq_idx, ord, CAST(sv_id AS BIGINT) AS sv_id, copy, CAST(r AS INT) AS row_ord, ['reference', 'simulated', 'expected'][r + 1] AS name, CAST(CASE r WHEN 0 THEN a_index ELSE put_at END AS BIGINT) AS start, CAST(CASE r WHEN 0 THEN a_len ELSE m END AS BIGINT) AS len,
  CASE r WHEN 0 THEN '+' ELSE strand END AS strand, length(CASE r WHEN 0 THEN seq ELSE sim END) AS src_size, CASE r WHEN 0 THEN substr(seq, CAST(a_index + 1 AS INT), CAST(a_len AS INT)) WHEN 1 THEN substr(sim, CAST(bpos + 1 AS INT), CAST(m AS INT)) ELSE v END AS seq
FROM od2, (SELECT unnest(range(3)) AS r)""")
def sv_truth_blocks(spark, sf_dir):
    """Truth blocks in order, one a copy: tandem duplications stand three times."""
    reference = seqs(spark, sf_dir)
    variants = simulate.place_variants(reference, WANTED)
    return simulate.truth_blocks(variants, simulate.variant_edits(variants, reference, times=3), reference)
