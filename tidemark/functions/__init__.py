"""Pure ``Column`` functions: no shuffles, no actions, all inside whole-stage codegen."""
