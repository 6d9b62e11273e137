"""What may go wrong, by kind.  Failures inside a running query are Spark's own errors; these are raised on the driver."""

from __future__ import annotations


class TallyloomError(ValueError):
    """Any of the errors below."""


class DatasetError(TallyloomError):
    """A file or table of samples that can't be used."""


class RecordError(TallyloomError):
    """Knowledge records that aren't valid, or aren't those of their manifest."""


class ConfigError(TallyloomError):
    """A configuration that can't be used."""


class RetrievalError(TallyloomError):
    """A search that can't be carried out."""


class SynthesisError(TallyloomError):
    """Questions that can't be made."""
