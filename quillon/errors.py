"""What can go wrong before analysis; the class names also fill error_type in dead-letter rows."""


class IngestionError(Exception):
    pass


class UnsupportedFileTypeError(IngestionError):
    pass


class NoTextFoundError(IngestionError):
    pass


class InvalidInputError(IngestionError):
    pass


class SourceConnectionError(IngestionError):
    pass


class ExtractionError(IngestionError):
    pass
