"""Streams of items. The batch operators are what is asked for; this is an extension of ours."""
