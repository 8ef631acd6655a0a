"""Technology stacks: coverage, explicit mentions, expansion into skills.

Stacks are a fixed dozen of short lists, so coverage is a row-local array
intersection per stack: no join, no shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import text, vocab
from postmill.functions.binding import let


def _strings(values) -> Column:
    return F.expr("array({})".format(", ".join(f"'{v}'" for v in values)))


def coverage(canonical_skills: Column, stack: str) -> Column:
    """Share of the stack's components present among the canonical names."""
    parts = vocab.STACKS[stack]
    return F.size(F.array_intersect(canonical_skills, _strings(parts))) / F.lit(len(parts))


def _covered(canonical_skills: Column, accept) -> Column:
    """Names of the stacks whose (found, size) component counts are accepted, sorted.

    One plain expression per stack: functions of list elements are interpreted, and sets built for every stack.
    """
    nothing = F.array().cast("array<string>")

    def stack_if_accepted(stack, parts):
        held = [F.when(F.array_contains(canonical_skills, part), 1).otherwise(0) for part in dict.fromkeys(parts)]
        return F.when(accept(sum(held[1:], held[0]), F.lit(len(parts))), F.array(F.lit(stack))).otherwise(nothing)

    return F.concat(*[stack_if_accepted(stack, parts) for stack, parts in sorted(vocab.STACKS.items())])


def complete_stacks(canonical_skills: Column) -> Column:
    return _covered(canonical_skills, lambda found, size: found == size)


def _is_partial(found: Column, size: Column) -> Column:
    # stacks of one or two components count only when complete
    return (found >= size * vocab.PARTIAL_COVERAGE) & (found < size) & (size > 2)


def partial_stacks(canonical_skills: Column) -> Column:
    """Stacks of more than two components that are at least half covered."""
    return _covered(canonical_skills, _is_partial)


def covered_stacks(canonical_skills: Column) -> Column:
    """Complete and partial stacks together."""
    return _covered(canonical_skills, lambda found, size: (found == size) | _is_partial(found, size))


def mentioned_stacks(cleaned: Column) -> Column:
    """Stacks named in the text, in upper case with the word STACK dropped."""
    hits = F.regexp_extract_all(cleaned, F.lit(text.STACK_PATTERN), F.lit(1))

    def spell(hit):
        upper = F.upper(hit)
        without_word = F.replace(upper, F.lit(" STACK"), F.lit(""))
        return F.replace(without_word, F.lit(".JS"), F.lit(".js"))

    return F.sort_array(F.array_distinct(F.transform(hits, spell)))


def all_stacks(canonical_skills: Column, cleaned: Column) -> Column:
    return F.sort_array(
        F.array_union(covered_stacks(canonical_skills), mentioned_stacks(cleaned))
    )


def _component_labels() -> Column:
    entries = ", ".join(
        "'{}', array({})".format(stack, ", ".join(f"'{text.label_of(p)}'" for p in parts)) for stack, parts in vocab.STACKS.items()
    )
    return F.expr(f"map({entries})")


def stack_skills(names: Column) -> Column:
    """Labels of the components of every listed stack; other names add nothing."""
    nothing = F.array().cast("array<string>")
    return F.flatten(F.transform(names, lambda s: F.coalesce(F.try_element_at(_component_labels(), s), nothing)))


def expand_skills(hard: Column, names: Column, expandable: Column) -> Column:
    """Hard skills plus stack names plus the components of the expandable stacks."""
    return F.sort_array(F.array_distinct(F.concat(hard, names, stack_skills(expandable))))


def tech_stack(stack_names: Column, hard: Column) -> Column:
    """Stored stack column: the stacks, or all hard skills when there is none."""
    return text.skill_names(F.when(F.size(stack_names) > 0, stack_names).otherwise(hard))
