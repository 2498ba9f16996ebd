"""arcweave: hypergraph analytics and training-data operators on Spark."""

from .expr import AggExpr, Expr
from .frames import EdgeFrame, Frame, FrameSchema, GroupedFrame, HyperedgeFrame, NodeFrame, PathFrame
from .functions import *  # noqa: F403
from .graph import Executor, Hypergraph, LocalExecutor, RayExecutor
from .operators.infer import Rule
from .operators.paths import Pattern, all_paths, shortest_path
from .schema import GraphSchema, Property
from .scope import AmbiguousColumn, ColumnNotFound

connect, create = Hypergraph.connect, Hypergraph.create

__all__ = ["AggExpr", "AmbiguousColumn", "ColumnNotFound", "EdgeFrame", "Executor", "Expr", "Frame", "FrameSchema", "GraphSchema", "GroupedFrame", "HyperedgeFrame", "Hypergraph", "LocalExecutor", "NodeFrame", "PathFrame", "Pattern", "Property", "RayExecutor", "Rule", "all_paths", "connect", "create", "shortest_path"]
