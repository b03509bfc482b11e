"""The row of an undissected packet and the nested layer tree."""

RAW_FRAMES = "capture_id string, frame_index long, ts_ns long, cap_len int, orig_len long, link_type int, data binary"

_LEAF = "name:string,value:string,start:int,end:int"
FIELD = f"struct<{_LEAF},children:array<struct<{_LEAF}>>>"
LAYER = f"struct<protocol:string,start:int,end:int,summary:string,truncated:boolean,fields:array<{FIELD}>>"
