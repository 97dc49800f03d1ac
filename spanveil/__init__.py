"""Personal data in text held in DataFrames: found, resolved, replaced.  The usual way in is
``spanveil.plans.pipeline`` (detect, redact) with a ``spanveil.config.Config``."""

from spanveil.config import DEFAULT, Config

__all__ = ["DEFAULT", "Config"]
