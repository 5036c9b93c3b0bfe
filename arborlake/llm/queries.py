"""Queries of the text operators and their SQL."""

from __future__ import annotations

from arborlake.llm import clusters, lookalikes, mixing, packing
from arborlake.runtime import read_table


def queries() -> dict:
    t = read_table
    return {
        "p4_found": lambda s, d: clusters.probe_pairs(t(s, d, "neurons"), t(s, d, "probes")),
        "p4_groups": lambda s, d: clusters.node_groups(t(s, d, "neurons")),
        "p4_clusters": lambda s, d: clusters.clusters(t(s, d, "neurons")),
        "p4_members": lambda s, d: clusters.node_clusters(t(s, d, "neurons")),
        "p8_packed": lambda s, d: packing.pack_documents(t(s, d, "documents"), t(s, d, "pack_targets")),
        "p8_containers": lambda s, d: packing.containers(t(s, d, "documents"), t(s, d, "pack_targets")),
        "p8_report": lambda s, d: packing.pack_report(t(s, d, "documents"), t(s, d, "pack_targets")),
        "p9_mixed": lambda s, d: mixing.mix_documents(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.mix_report(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p10_found": lambda s, d: lookalikes.lookalike_pairs(t(s, d, "documents")),
        "p10_classes": lambda s, d: lookalikes.lookalike_classes(t(s, d, "documents")),
        "p10_texts": lambda s, d: lookalikes.canonical_texts(t(s, d, "documents"), ["doc_id"]),
    }


#: Side of the cells that name groups; the least cell of a group is its name.
_SIDE = clusters._side(60.0)
_GROUPS = f"""WITH RECURSIVE pts AS (SELECT file_id, node_id, MIN(x) AS x, MIN(y) AS y, MIN(z) AS z FROM neurons WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND file_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY file_id, node_id) AS id, CAST(FLOOR(x / 60) AS BIGINT) AS a, CAST(FLOOR(y / 60) AS BIGINT) AS b, CAST(FLOOR(z / 60) AS BIGINT) AS c FROM pts),
steps AS (SELECT i.range - 1 AS da, j.range - 1 AS db, k.range - 1 AS dc FROM range(3) i CROSS JOIN range(3) j CROSS JOIN range(3) k),
e AS (SELECT s.id AS u, t.id AS v FROM (SELECT p.*, a + da AS ta, b + db AS tb, c + dc AS tc FROM p CROSS JOIN steps) s JOIN p t ON s.ta = t.a AND s.tb = t.b AND s.tc = t.c AND s.id <> t.id
  WHERE (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) <= 3600),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM p UNION SELECT r.id, MIN(w.comp) FROM recurring.cc r JOIN e ON r.id = e.u JOIN cc w ON e.v = w.id WHERE w.comp < r.comp GROUP BY r.id),
sized AS (SELECT p.*, comp, COUNT(*) OVER (PARTITION BY comp) AS group_size, MIN((CAST(FLOOR(x / {_SIDE}) AS BIGINT), CAST(FLOOR(y / {_SIDE}) AS BIGINT), CAST(FLOOR(z / {_SIDE}) AS BIGINT))) OVER (PARTITION BY comp) AS least FROM p JOIN cc USING (id)),
groups AS (SELECT file_id, node_id, concat_ws(' ', least[1], least[2], least[3]) AS group_id, comp, group_size FROM sized WHERE group_size >= 40)"""


def oracle_sql() -> dict[str, str]:
    """The groups of problem 4. SQL has no k-means, no tokenizer, no packing and no decomposition of characters: the other queries are held against brute force in the tests."""
    return {
        "p4_found": _GROUPS + " SELECT DISTINCT x.probe_id AS probe_a, y.probe_id AS probe_b FROM probes x JOIN groups g ON x.file_id = g.file_id AND x.node_id = g.node_id JOIN groups h ON g.comp = h.comp JOIN probes y ON y.file_id = h.file_id AND y.node_id = h.node_id WHERE x.probe_id < y.probe_id",
        "p4_groups": _GROUPS + " SELECT file_id, node_id, group_id, group_size FROM groups",
    }
