"""Named errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises by itself."""


def _make(name: str, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"__doc__": doc, "__module__": __name__})


ParseError = _make("ParseError", "The statement is not in the dialect.")
TableNotFound = _make("TableNotFound", "No such table.")
TableExists = _make("TableExists", "The table exists already.")
ColumnNotFound = _make("ColumnNotFound", "No such column.")
AmbiguousColumn = _make("AmbiguousColumn", "A bare name fits several columns.")
MissingParameter = _make("MissingParameter", "A $parameter has no value.")
ImmutableTable = _make("ImmutableTable", "The table accepts inserts only.")
ImmutableColumn = _make("ImmutableColumn", "The column cannot change once written.")
InvalidStateTransition = _make("InvalidStateTransition", "The state machine has no such transition.")
UniqueViolation = _make("UniqueViolation", "A key is taken.")
ForeignKeyViolation = _make("ForeignKeyViolation", "A reference has no parent row.")
NotNullViolation = _make("NotNullViolation", "A required column has no value.")
CycleDetected = _make("CycleDetected", "An edge would close a cycle of an acyclic edge type.")
PropagationAborted = _make("PropagationAborted", "A propagated change is not allowed and the rule aborts.")
BfsDepthExceeded = _make("BfsDepthExceeded", "A traversal may be 10 steps deep at most.")
BfsVisitedExceeded = _make("BfsVisitedExceeded", "A traversal reaches too many nodes.")
UnboundedTraversal = _make("UnboundedTraversal", "A traversal needs an upper bound.")
UnboundedVectorSearch = _make("UnboundedVectorSearch", "A vector search needs LIMIT.")
UnknownVectorIndex = _make("UnknownVectorIndex", "The column is no vector column.")
VectorDimensionMismatch = _make("VectorDimensionMismatch", "A vector has another length than its column.")
RankPolicyNotFound = _make("RankPolicyNotFound", "No rank policy has that sort key.")
RankPolicyInvalid = _make("RankPolicyInvalid", "A rank policy's formula or join cannot be used.")
RecursiveCteNotSupported = _make("RecursiveCteNotSupported", "WITH RECURSIVE is not in the dialect.")
WindowFunctionNotSupported = _make("WindowFunctionNotSupported", "OVER is not in the dialect.")
StoredProcNotSupported = _make("StoredProcNotSupported", "Procedures and functions are not in the dialect.")
FullTextSearchNotSupported = _make("FullTextSearchNotSupported", "WHERE col MATCH is not in the dialect.")
SubqueryNotSupported = _make("SubqueryNotSupported", "Only col IN (SELECT one column) is in the dialect.")
IndexNotFound = _make("IndexNotFound", "No such index.")
DuplicateIndex = _make("DuplicateIndex", "The index exists already.")
ColumnNotIndexable = _make("ColumnNotIndexable", "JSON and vector columns cannot be indexed.")
ColumnInIndex = _make("ColumnInIndex", "An index uses the column.")
CommitConflict = _make("CommitConflict", "Another writer has committed first.")
PluginRejected = _make("PluginRejected", "A plugin has refused the operation.")
BudgetExceeded = _make("BudgetExceeded", "The store is over its disk limit.")
