"""textmend subpackage."""
