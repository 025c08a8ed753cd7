"""Graph queries again, on every edge of next_supp: those they repeat run on one or two followers a supplier.

A query keeps its SQL, with the capped view read as all of next_supp. Where top_next only selects nodes
or edges out of the graph it stays. g2's SQL lists all simple paths; here it is one that keeps the least path of every length.
The whole graph is one component, so g6_condensation would have no rows and isn't repeated.
"""

from __future__ import annotations

from . import graph_queries, path_queries  # noqa: F401  they register
from .base import ORACLE_SQL, QUERIES
from .views import SQL, whole

MAIN = "g1_reachable g3_constrained_walk g4_bounded_walk_product g16_reflexive_closure p1_map_edges p3_transpose j1_edge_lookup j2_edges_from_to j3_keep_remove j4_compose j9_relative_extremes j10_implication a16_bounds u1_union_left u2_union_with"
TOP = "g2_shortest_paths g5_strong_components g6_component_reach g7_acyclic g14_constraint_forest a3_node_sets"


def _register(name: str, view: str) -> None:
    def f(spark, sf):
        with whole(view):
            return QUERIES[name](spark, sf)

    f.__name__ = f"{name}_whole"
    QUERIES[f.__name__] = f
    if name in ORACLE_SQL and name != "g2_shortest_paths":
        ORACLE_SQL[f.__name__] = ORACLE_SQL[name].replace(f"{view} as ({SQL[view]})", f"{view} as (select * from next_supp)")


for _names, _view in ((MAIN, "main_next"), (TOP, "top_next")):
    for _name in _names.split():
        _register(_name, _view)

ORACLE_SQL["g2_shortest_paths_whole"] = f"""with recursive next_supp as ({SQL["next_supp"]}), b(id, hops, path) as (select min(src), 0, [min(src)] from next_supp union all
  select * from (select e.dst, b.hops + 1, min(list_append(b.path, e.dst)) from b join next_supp e on e.src = b.id where b.hops < 20 group by e.dst, b.hops))
select id, min(hops) as hops, arg_min(path, hops) as path from b group by id"""
