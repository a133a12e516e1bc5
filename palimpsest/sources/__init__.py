from .event_log import EventLog

__all__ = ["EventLog"]
