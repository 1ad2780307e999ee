"""Readers and writers of graphs and tables."""

from .graphs import FORMATS, read_graph, write_graph
from .relations import read_folder, read_relations, write_folder, write_relations
from .workspace import Workspace, write_workspace

__all__ = ["FORMATS", "Workspace", "read_folder", "read_graph", "read_relations", "write_folder", "write_graph", "write_relations", "write_workspace"]
