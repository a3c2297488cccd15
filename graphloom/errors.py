"""Errors, by where they arise and what is wrong."""


class GraphError(Exception):
    """Base of all errors of this package."""


class EngineError(GraphError):
    """Spark could not run a query."""


class StorageError(GraphError):
    """A folder or file that cannot be read or written."""


class BadJson(GraphError):
    """Text that is no JSON object where one is needed."""


class NotFound(GraphError):
    """A node, edge or snapshot that is not there."""


class Conflict(GraphError):
    """Other writers were first, as often as a change was tried."""


class SchemaError(GraphError):
    """A schema that cannot be read or contradicts itself."""


class SchemaSyntax(SchemaError):
    """Text that is no TOML, or no schema."""


class SchemaUnreadable(SchemaError, StorageError):
    """A schema file that cannot be read."""


class BadType(SchemaError):
    """A property type that does not exist."""


class UnknownNodeKind(SchemaError):
    """An edge kind whose end is no node kind."""


class UnknownEdgeKind(SchemaError):
    """An edge kind without ends."""


class ValidationError(GraphError):
    """A node, edge, property, filter or path that the schema does not allow."""


class UnknownKind(ValidationError):
    pass


class UnknownEdge(ValidationError):
    pass


class UnknownProperty(ValidationError):
    pass


class MissingProperty(ValidationError):
    pass


class BlankValue(ValidationError):
    pass


class NotAVariant(ValidationError):
    pass


class WrongType(ValidationError):
    pass


class WrongEnds(ValidationError):
    pass


class BadDocument(ValidationError, BadJson):
    pass


#: How messages of validation columns begin, and what they are raised as.
CASES = {
    "unknown node kind": UnknownKind,
    "unknown edge kind": UnknownEdge,
    "unknown property": UnknownProperty,
    "missing property": MissingProperty,
    "blank property": BlankValue,
    "not a variant": NotAVariant,
    "not a string": WrongType,
    "not int": WrongType,
    "not float": WrongType,
    "not bool": WrongType,
    "invalid endpoints": WrongEnds,
    "properties are no JSON object": BadDocument,
}


def raised(messages: list[str]) -> ValidationError:
    """The error of the first message, which says all of them."""
    return CASES.get(messages[0].partition(":")[0], ValidationError)("; ".join(messages))
