"""Turn messenger exports into token-bounded training conversations on Spark."""

from chatloom.config import FineTuneConfig, PrepConfig

__all__ = ["FineTuneConfig", "PrepConfig"]
