"""Switches for results that the agenda's users rely on although they look like slips. All are on by default; turning one
off gives what one would expect instead."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    #: A merge takes 0.0 and False of the better record for empty and fills them from the other.
    zero_is_empty: bool = True
    #: When the later record is the better one, the merged links lack its own.
    later_loses_link: bool = True
    #: A plan with editions on two days keeps the mode of its base record; from three on it is "multiple".
    two_days_keep_mode: bool = True
    #: Words with accents that raise a score never meet the folded text.
    accents_never_meet: bool = True
    #: An unknown zone takes every plan, and a zone's name is looked for with its accents.
    zones_as_written: bool = True
    #: An address that could not be resolved is cached as such and not asked for again.
    failures_are_cached: bool = True
    #: Plans that are over take part in a merge and leave only when feeds are published.
    merge_what_is_over: bool = True
    #: Undated plans go by their titles downwards.
    undated_titles_fall: bool = True
    #: The feed's first links are taken before those that lead nowhere are left out.
    links_cut_first: bool = True
    #: Sources of a plan are listed only where there are several.
    one_source_unlisted: bool = True


KEPT = Compat()
