from loglake.streaming.follow import follow_file
from loglake.streaming.tail import Tail, tail_filter, tail_stream
from loglake.streaming.windows import end_marks, flow_sessions_stream, mark_end, timeline_stream

__all__ = ["Tail", "end_marks", "flow_sessions_stream", "follow_file", "mark_end", "tail_filter", "tail_stream", "timeline_stream"]
