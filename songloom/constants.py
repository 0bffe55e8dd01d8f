"""Literals that must be equal to those in existing data and prompts."""

# State markers stored inside data columns.
UNFINISHED = "Unfinished"
UNSCRAPABLE = "Unscrapable"
NOT_SEARCHED = "YEEHAW"
BOOKMARKED = "BOOKMARKED"

# Catalogue columns that are not song sections.
NON_SECTION_COLUMNS = ("bpm", "title", "artist")

# Texts of prompts and of training examples.
PROMPT_TEMPLATE = "Write a {section} like {artist}"
EXAMPLE_TEMPLATE = "### Question: {question}\n ### Answer: {answer}"

# Sizes used when text is cut for training.
WINDOW_LENGTH = 40
WINDOW_STEP = 3
TOKEN_CAP = 40

# Temperatures of the sampling sweep.
TEMPERATURES = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 1.2, 1.5, 2.0)

# Markup that holds the fields of a song page.
LYRICS_CLASS = "song_body-lyrics"
TITLE_CLASS = "header_with_cover_art-primary_info-title"
INFO_CLASS = "u-xx_large_vertical_margins show_tiny_edit_button_on_hover"
FEATURES_CLASS = "metadata_unit-info"
SONG_LINK_CLASS = "mini_card mini_card--small"

# Markup of a page of tempo search hits.
HIT_CLASS = "media"
HIT_ARTIST_CLASS = "subtitle is-6 artist-name"
HIT_TITLE_CLASS = "title is-4 track-name"
HIT_BPM_CLASS = "title"
