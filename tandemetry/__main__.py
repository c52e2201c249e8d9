from tandemetry.commands import main

main()
