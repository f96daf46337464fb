from lodestar.functions.scalar import (  # noqa: F401
    FALLBACK_TITLES,
    GENRE_TITLES,
    KILL_ACTION,
    KNOWN_GAME_TYPES,
    compact,
    day_of,
    genre_title,
    percent_of,
    preferred_type,
    seconds_between,
    skill_level,
    skill_title,
    stamp,
    truthy,
    type_title,
)
