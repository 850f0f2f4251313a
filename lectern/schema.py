"""Schemas of the log and of what is derived from it."""

from __future__ import annotations

#: One message of the log; `t` tells which of the fields are set.
MESSAGE = (
    "talk string, seq bigint, t string, sid bigint, rev bigint, final boolean, stable boolean, lang string, spk string, "
    "spk_conf double, text string, conf double, t0 double, t1 double, emitted_at double, title string, src_lang string, state string"
)

#: Current state of a segment.
SEGMENT = "talk string, sid bigint, rev bigint, final boolean, lang string, text string, spk string"

WORD = "struct<text:string,t0:double,t1:double,prob:double>"

#: What an absent field of a `seg` message means.
SEG_DEFAULTS = {"final": False, "spk_conf": 0.0, "text": "", "conf": 0.0, "t0": 0.0, "t1": 0.0, "emitted_at": 0.0}
